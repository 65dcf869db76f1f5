"""Attach the values of a one-row aggregate to every row of another frame.

Written as scalar subqueries (``DataFrame.scalar()``), not as a cross join:
the aggregate runs once, its value is a literal in the consuming
projection, and Catalyst merges several scalars over the same aggregate
into one subquery.  A global aggregate always has exactly one row, so the
values are null (never a dropped row) when its input is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def with_scalars(df: DataFrame, one_row: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or one_row.columns)
    if len(cols) == 1:
        return df.select("*", one_row.select(cols[0]).scalar().alias(cols[0]))
    # One subquery for all values: pack them into a struct bound to one
    # column, then unpack the fields from that column.
    packed = one_row.select(F.struct(*[F.col(c) for c in cols]).alias("__s")).scalar()
    tmp = df.select("*", packed.alias("__scalars"))
    return tmp.select(*[tmp[c] for c in df.columns], *[F.col("__scalars").getField(c).alias(c) for c in cols])


def scalar_frame(one_row: DataFrame, *others: DataFrame) -> DataFrame:
    """Combine several one-row aggregates into one row (side by side)."""
    out = one_row
    for o in others:
        out = with_scalars(out, o)
    return out
