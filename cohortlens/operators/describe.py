"""Descriptive statistics: describe(), box-plot numbers, IQR fences, ECDF,
equal-width density histograms.  The first three share one pass over the
input, its value counts (``ranks.Distribution``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.common import round_half_up, safe_div
from cohortlens.operators.ranks import Distribution, attach, null_safe
from cohortlens.session import written


def described(dist: Distribution, dp: int = 4) -> DataFrame:
    """``describe`` of a distribution that is at hand."""
    by = dist.by
    j = null_safe(dist.moments(), dist.quantiles({"p25": .25, "p50": .5, "p75": .75}), by, "left")
    r = lambda c: round_half_up(c, dp).alias(c)
    return j.select(*by, "count", r("mean"), r("std"), "min", r("p25"), r("p50"), r("p75"), "max")


def describe(df: DataFrame, value: str, by: Sequence[str] = (), dp: int = 4) -> DataFrame:
    """pandas ``describe()``: count, mean, std (ddof=1), min, quartiles, max.

    Quartiles are interpolated (``PERCENTILE_CONT``); nulls are ignored.
    Group keys follow pandas: null keys are dropped.  The input is evaluated
    once.
    """
    for k in by:
        df = df.where(F.col(k).isNotNull())
    return described(Distribution.of(df, value, by), dp)


def _fenced(dist: Distribution, probs: dict[str, float], k: float) -> DataFrame:
    """Quartiles with the fences ``k`` interquartile ranges outside, and the rows on both sides of them."""
    iqr = F.col("q3") - F.col("q1")
    q = dist.quantiles(probs).withColumns({"iqr": iqr, "lower": F.col("q1") - k * iqr, "upper": F.col("q3") + k * iqr})
    return dist.around(q, "lower", "upper")


def iqr_bounds(df: DataFrame, value: str, k: float = 1.5, by: Sequence[str] = (), dp: int = 4) -> DataFrame:
    """Tukey fences q1 - k*IQR, q3 + k*IQR and the ECDF at the upper fence (share of non-null values <= it)."""
    by = list(by)
    out = _fenced(Distribution.of(df.where(F.col(value).isNotNull()), value, by), {"q1": .25, "q3": .75}, k)
    ecdf = safe_div(F.col("up_to"), F.col("up_to") + F.col("above"))
    r = lambda c: round_half_up(c, dp).alias(c)
    return out.select(*by, r("q1"), r("q3"), r("iqr"), r("lower"), r("upper"),
                      round_half_up(ecdf * 100.0, dp).alias("upper_percentile"))


def boxed(dist: Distribution, k: float = 1.5, dp: int = 4) -> DataFrame:
    """``box_stats`` of a distribution that is at hand."""
    g = _fenced(dist, {"q1": .25, "median": .5, "q3": .75}, k)
    r = lambda c, name=None: round_half_up(c, dp).alias(name or c)
    return g.select(*dist.by, r("q1"), r("median"), r("q3"), r("inner_low", "whisker_low"),
                    r("inner_high", "whisker_high"), (F.col("below") + F.col("above")).alias("fliers"))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5, dp: int = 4) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers at the extreme points within
    k*IQR of the box, and the number of fliers."""
    return boxed(Distribution.of(df.where(F.col(value).isNotNull()), value, by), k, dp)


def density_histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 30,
                      dp: int = 6, density_dp: int = 10) -> DataFrame:
    """Equal-width histogram over each group's [min, max], as a density.

    The last bin is closed on the right (numpy).  Empty bins are emitted with
    count 0 by exploding ``sequence(0, bins-1)`` per group (bins * groups rows).
    """
    by = list(by)
    for k in by:
        df = df.where(F.col(k).isNotNull())
    dist = Distribution.of(df.where(F.col(value).isNotNull()), value, by)
    # The ranges and the bins both come from the value counts; the ranges, one
    # row a group, meet them salted or by a counted broadcast.
    rng = written(dist.index().groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                                F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "ranges")
    width = (F.col("hi") - F.col("lo")) / float(bins)
    j = attach(dist.counts, rng, by, dist.groups())
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("__v").cast("double") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    cnt = j.groupBy(*by, idx.alias("bin")).agg(F.sum("__c").alias("count"))
    grid = rng.select(*by, "lo", "hi", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    g = null_safe(grid, cnt, by + ["bin"], "left")
    w = (F.col("hi") - F.col("lo")) / float(bins)
    low = F.col("lo") + F.col("bin") * w
    return g.select(*by, "bin", round_half_up(low, dp).alias("low"),
                    round_half_up(low + w, dp).alias("high"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    round_half_up(safe_div(F.coalesce(F.col("count"), F.lit(0)), F.col("n") * w), density_dp)
                    .alias("density"))
