"""Column profiling: nulls, null share and distinct count per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.common import round_half_up, safe_div


def profile(df: DataFrame, name: str, cols: Sequence[str] | None = None, dp: int = 2,
            approx_rsd: float | None = None) -> DataFrame:
    """One row per column: dataset, column, type, rows, nulls, null_pct, distinct.

    One aggregate over one pass of the input.  Rows and nulls are plain counts;
    distinct counts of all columns are expanded by Spark into one shuffle of
    native values that is combined map-side, so a column with a dominant or
    few values costs next to nothing.  ``approx_rsd`` replaces the shuffle by
    fixed-size sketches.
    """
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    type_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    count = F.countDistinct if approx_rsd is None else (lambda c: F.approx_count_distinct(c, approx_rsd))
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[count(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    long = agg.select("rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("distinct"))
        for i, c in enumerate(cols)])).alias("c")).select("rows", "c.*")
    nulls = F.col("rows") - F.col("n")
    return long.select(F.lit(name).alias("dataset"), "column", type_map[F.col("column")].alias("type"), "rows",
                       nulls.alias("nulls"), round_half_up(safe_div(nulls * 100.0, "rows"), dp).alias("null_pct"),
                       "distinct")
