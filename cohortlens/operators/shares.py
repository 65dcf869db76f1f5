"""Value distributions and shares (``value_counts`` with percentages)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.common import round_half_up, safe_div
from cohortlens.operators.scalar import with_scalars


def value_share(df: DataFrame, col: str, where: Column | None = None, dp: int = 2,
                count_col: str = "count", pct_col: str = "pct", rounding=round_half_up) -> DataFrame:
    """Counts of each non-null value and its percentage of the non-null total."""
    x = df if where is None else df.where(where)
    g = x.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias(count_col))
    # The total is a one-row aggregate attached as a scalar subquery.
    tot = g.agg(F.sum(count_col).alias("__t"))
    return (with_scalars(g, tot)
            .select("value", count_col, rounding(safe_div(F.col(count_col) * 100.0, "__t"), dp)
                    .alias(pct_col)))


def share_within(df: DataFrame, parent: Sequence[str], value: str, out: str = "share",
                 scale: float = 100.0) -> DataFrame:
    """Add ``value / sum(value) over (parent)`` to an already aggregated frame."""
    w = Window.partitionBy(*parent)
    return df.withColumn(out, safe_div(F.col(value) * scale, F.sum(value).over(w)))
