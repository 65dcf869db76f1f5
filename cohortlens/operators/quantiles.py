"""Quantiles (discrete and interpolated) per group.

Semantics
---------
* ``kind="disc"``  - SQL ``PERCENTILE_DISC(p)``: the first value whose
  cumulative share reaches ``p`` (1-based rank ``max(1, ceil(p * n))``).
* ``kind="cont"``  - SQL ``PERCENTILE_CONT`` / pandas ``quantile``: linear
  interpolation between 0-based ranks ``floor(h)`` and ``ceil(h)``,
  ``h = p * (n - 1)``.
Nulls are ignored; a group whose values are all null yields no row.

Methods
-------
``exact`` (default) counts the values of each group once and finds the ranks
by refining ranges of values (see ``ranks.Distribution``): no task holds a
group, whatever its number of distinct values.

``builtin`` uses Spark's ``percentile`` / ``percentile_disc`` aggregates
(one pass; memory per group proportional to its distinct values), fine when
group cardinality is known to be small.  ``approx`` uses
``percentile_approx`` (bounded memory, rank error ~ n / accuracy).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators.ranks import Distribution, probabilities


def quantiles(df: DataFrame, value: str | Column, probs, by: Sequence[str] = (),
              kind: str = "cont", method: str = "exact", accuracy: int = 10000,
              out_type: str = "double") -> DataFrame:
    """Quantiles of ``value`` per ``by`` group, one column per probability.

    ``probs`` is a list of fractions (columns named ``p25``, ``p50``...) or a
    mapping ``{column_name: fraction}``.
    """
    if kind not in ("cont", "disc"):
        raise ValueError("kind must be 'cont' or 'disc'")
    by, v = list(by), F.col(value) if isinstance(value, str) else value
    base = df.select(*by, v.alias("__v")).where(F.col("__v").isNotNull())
    if method == "exact":
        return Distribution.of(base, "__v", by).quantiles(probs, kind, out_type)
    pm = probabilities(probs)
    if method == "approx":
        aggs = {n: F.percentile_approx("__v", p, accuracy) for n, p in pm.items()}
    elif method == "builtin" and kind == "cont":
        aggs = {n: F.percentile(F.col("__v"), F.lit(p)) for n, p in pm.items()}
    elif method == "builtin":
        aggs = {n: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY __v)") for n, p in pm.items()}
    else:
        raise ValueError(f"unknown method {method}")
    return base.groupBy(*by).agg(*[a.cast(out_type).alias(n) for n, a in aggs.items()])


def quantiles_from_counts(counts: DataFrame, value: str, count: str, probs, by: Sequence[str] = (),
                          kind: str = "cont", out_type: str = "double") -> DataFrame:
    """Exact quantiles from an already aggregated (group, value, count)
    frame - e.g. a pre-aggregate shared with other metrics - so the raw rows
    are not read again."""
    rows = counts.where(F.col(value).isNotNull())
    return Distribution.of_counts(rows, value, count, by).quantiles(probs, kind, out_type)


def median(df: DataFrame, value: str, by: Sequence[str] = (), kind: str = "cont",
           method: str = "exact") -> DataFrame:
    return quantiles(df, value, {"median": 0.5}, by, kind=kind, method=method)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs, by: Sequence[str] = (),
                     kind: str = "cont", method: str = "exact") -> DataFrame:
    """Quantiles of several columns in one distributed pass.

    The columns are unpivoted to ``(column, value)`` rows and handled as one
    more grouping key, so k columns cost one shuffle instead of k.  Returns one
    row per ``by`` group with columns ``{col}_{prob_name}``.
    """
    pm, by = probabilities(probs), list(by)
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__val")) for c in cols
    ])).alias("__kv")).select(*by, "__kv.__col", "__kv.__val")
    q = quantiles(long, "__val", pm, by + ["__col"], kind=kind, method=method)
    aggs = [F.max(F.when(F.col("__col") == c, F.col(n))).alias(f"{c}_{n}") for c in cols for n in pm]
    return q.groupBy(*by).agg(*aggs)
