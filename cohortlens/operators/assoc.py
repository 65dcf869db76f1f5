"""Association between mixed-type columns: contingency chi-square,
Cramer's V and the phi_K correlation (Baak et al., arXiv:1811.11440).

Distributed part: interval columns are cut into ``bins`` equal-width bins
over [min, max] (the bounds are a one-row aggregate, broadcast), every row
emits one (pair, value_a, value_b) record per column pair, and a
map-side-combined ``groupBy`` builds all contingency tables in one shuffle.
The non-empty cells are written once; marginals are aggregates of them, and
joins on (pair, value) bring them back, so no task holds a pair's table.

Only the phi_K inversion is Python: a vectorised pandas UDF over the
per-pair rows (one row per column pair) that solves chi2(rho) = observed for
a bivariate normal cut into as many equal-width bins as the table has rows
and columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.common import round_half_up
from cohortlens.session import written


def _binned(df: DataFrame, cols: Sequence[str], interval_cols: Sequence[str], bins: int) -> DataFrame:
    iv = [c for c in cols if c in set(interval_cols)]
    bounds = {}
    if iv:
        # Two numbers per interval column: fetched once as literals (bounded).
        r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"__lo_{c}") for c in iv],
                   *[F.max(F.col(c).cast("double")).alias(f"__hi_{c}") for c in iv]).first()
        bounds = {c: (F.lit(r[f"__lo_{c}"]).cast("double"), F.lit(r[f"__hi_{c}"]).cast("double")) for c in iv}
    out = []
    for c in cols:
        if c in iv:
            lo, hi = bounds[c]
            v = F.col(c).cast("double")
            b = F.when(hi == lo, F.lit(0)).otherwise(
                F.least(F.floor((v - lo) / ((hi - lo) / float(bins))), F.lit(bins - 1)))
            out.append(F.when(v.isNull(), F.lit(None)).otherwise(b.cast("long").cast("string")).alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


def contingency_cells(df: DataFrame, cols: Sequence[str], interval_cols: Sequence[str] = (),
                      bins: int = 10) -> DataFrame:
    """Non-empty cells (col_a, col_b, va, vb, n) of every pairwise table
    (rows with a null in either column of a pair are dropped for that pair)."""
    cols = list(cols)
    b = _binned(df, cols, interval_cols, bins)
    pairs = [(a, c) for i, a in enumerate(cols) for c in cols[i + 1:]]
    rec = F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(c).alias("col_b"), F.col(a).alias("va"), F.col(c).alias("vb"))
        for a, c in pairs]))
    long = b.select(rec.alias("r")).select("r.*").where(F.col("va").isNotNull() & F.col("vb").isNotNull())
    return long.groupBy("col_a", "col_b", "va", "vb").agg(F.count(F.lit(1)).alias("n"))


def chi2_matrix(df: DataFrame, cols: Sequence[str], interval_cols: Sequence[str] = (), bins: int = 10,
                dp: int = 6) -> DataFrame:
    """Per column pair: n, Pearson chi2, degrees of freedom, Cramer's V.

    chi2 = sum(o^2 / e) - n over the non-empty cells (equivalent to the sum
    over the full table, since an empty cell contributes exactly its
    expectation).  Empty rows/columns do not count towards the dof.
    """
    cells = written(contingency_cells(df, cols, interval_cols, bins), "cells")
    pair = ["col_a", "col_b"]
    rows = cells.groupBy(*pair, "va").agg(F.sum("n").alias("ra"))
    columns = cells.groupBy(*pair, "vb").agg(F.sum("n").alias("cb"))
    sizes = rows.groupBy(*pair).agg(F.sum("ra").alias("total"), F.count(F.lit(1)).alias("r")).join(
        columns.groupBy(*pair).agg(F.count(F.lit(1)).alias("k")), pair)
    # doubles: n^2 * total overflows a long at scale
    n = F.col("n").cast("double")
    shares = cells.join(rows, [*pair, "va"]).join(columns, [*pair, "vb"]).groupBy(*pair).agg(
        F.sum(n * n / (F.col("ra").cast("double") * F.col("cb"))).alias("share"))
    g = sizes.join(shares, pair).withColumn("chi2", F.col("total") * F.col("share") - F.col("total"))
    m = F.least(F.col("r"), F.col("k")) - 1
    return g.select("col_a", "col_b", F.col("total").cast("long").alias("n"),
                    round_half_up(F.greatest(F.col("chi2"), F.lit(0.0)), dp).alias("chi2"),
                    ((F.col("r") - 1) * (F.col("k") - 1)).cast("long").alias("dof"),
                    round_half_up(F.sqrt(F.try_divide(F.greatest(F.col("chi2"), F.lit(0.0)), F.col("total") * m)), dp)
                    .alias("cramers_v"),
                    F.col("r").cast("int").alias("rows"), F.col("k").cast("int").alias("cols"))


# ---------------------------------------------------------------- phi_K inversion (numpy)
EDGE = 5.0  # the reference distribution is cut into equal-width bins over -EDGE .. EDGE
NODES = 160  # of the Gauss-Legendre rule
CHUNK = 1 << 22


def _edges(bins: int) -> np.ndarray:
    return np.linspace(-EDGE, EDGE, bins + 1)


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.array([NormalDist().cdf(v) for v in x])


def _excess(rho: float, nx: int, ny: int) -> np.ndarray:
    """Cell probabilities of the standard bivariate normal less those at correlation 0.

    The derivative of its distribution function by rho is its density, so the
    excess at a corner (h, k) is the density's integral over correlations
    0 .. rho, here with rho = sin(theta) by a Gauss-Legendre rule; a cell is
    the second difference of its corners.  Worked through by rows of corners,
    so memory is bounded; work is proportional to the cells.
    """
    node, weight = np.polynomial.legendre.leggauss(NODES)
    top = math.asin(rho)
    theta, weight = (node + 1) * top / 2, weight * top / 2
    sine, cosine2 = np.sin(theta), np.cos(theta) ** 2
    h, k = _edges(nx), _edges(ny)
    corner = np.empty((nx + 1, ny + 1))
    step = max(1, CHUNK // ((ny + 1) * NODES))
    for i in range(0, nx + 1, step):
        a, b = h[i:i + step, None, None], k[None, :, None]
        corner[i:i + step] = np.exp(-(a * a + b * b - 2 * a * b * sine) / (2 * cosine2)) @ weight / (2 * math.pi)
    return np.diff(np.diff(corner, axis=0), axis=1)


def phik_from_chi2(chi2: float, n: float, nx: int, ny: int, pedestal: float) -> float:
    """Correlation of the binned bivariate normal with this chi-square.

    chi2(rho) = pedestal + scale * n * sum((p(rho) - p(0))^2 / p(0)), where the
    scale lets rho = 1 reach n * min(nx - 1, ny - 1).  A bracketed false
    position (with halved weights) finds the root.  NaN for a table with one
    row or column.
    """
    if nx < 2 or ny < 2 or n <= 0 or chi2 is None or math.isnan(chi2):
        return math.nan
    most = n * min(nx - 1, ny - 1)
    if chi2 <= pedestal:
        return 0.0
    if chi2 >= most:
        return 1.0
    fx, fy = _cdf(_edges(nx)), _cdf(_edges(ny))
    base = np.outer(np.diff(fx), np.diff(fy))
    # Correlation 1: a cell has what its two intervals have in common.
    low, high = np.maximum.outer(fx[:-1], fy[:-1]), np.minimum.outer(fx[1:], fy[1:])
    one = float(((np.maximum(high - low, 0.0) - base) ** 2 / base).sum())
    goal = (chi2 - pedestal) / (most - pedestal)

    def miss(rho: float) -> float:
        return float((_excess(rho, nx, ny) ** 2 / base).sum()) / one - goal

    a, b, fa, fb, side = 0.0, 1.0, -goal, 1.0 - goal, 0
    for _ in range(100):
        rho = (a * fb - b * fa) / (fb - fa)
        f = miss(rho)
        if f < 0:
            a, fa, fb, side = rho, f, fb / 2 if side < 0 else fb, -1
        else:
            b, fb, fa, side = rho, f, fa / 2 if side > 0 else fa, 1
        if abs(f) < 1e-12 or b - a < 1e-9:
            break
    return rho


def _phik_udf():
    @F.pandas_udf("double")
    def phik(chi2: pd.Series, n: pd.Series, r: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([phik_from_chi2(float(c), float(m), int(a), int(b), float(d))
                          for c, m, a, b, d in zip(chi2, n, r, k, dof)])
    return phik


def phik_matrix(df: DataFrame, cols: Sequence[str], interval_cols: Sequence[str] = (), bins: int = 10,
                noise_correction: bool = True, dp: int = 4) -> DataFrame:
    """chi2 / Cramer's V per pair plus phi_K (pedestal = dof when
    ``noise_correction``)."""
    m = chi2_matrix(df, cols, interval_cols, bins)
    ped = F.col("dof").cast("double") if noise_correction else F.lit(0.0)
    return m.withColumn("phik", round_half_up(
        _phik_udf()(F.col("chi2"), F.col("n").cast("double"), F.col("rows"), F.col("cols"), ped), dp))


def strongest_correlate(matrix: DataFrame, target: str, metric: str = "phik") -> DataFrame:
    """The column most associated with ``target`` (largest |metric|; ties by name)."""
    other = F.when(F.col("col_a") == target, F.col("col_b")).otherwise(F.col("col_a"))
    x = matrix.where((F.col("col_a") == target) | (F.col("col_b") == target)).select(
        other.alias("column"), F.col(metric).alias("value"))
    return x.orderBy(F.abs("value").desc_nulls_last(), "column").limit(1)
