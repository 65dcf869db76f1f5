"""Order-dependent deduplication, made explicit.

Spark rows have no inherent order, so every keep-first/last operator takes
the column that defines "first".  Rows are written once with a place (a
number) and a digest of their content; decisions are made on keys, order and
places alone, and the rows themselves are fetched by their place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.ranks import attach
from cohortlens.session import written

PLACE, CONTENT = "__place", "__content"


def _columns(x: Sequence[str] | str) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def keep_one(df: DataFrame, key: Sequence[str] | str, order: Sequence[str] | str,
             keep: str = "first") -> DataFrame:
    """``drop_duplicates(subset=key, keep=first|last)`` ordered by ``order``.

    The least (``first``) or greatest (``last``) of (order, content, place) is
    aggregated for each key, combined map-side, so a hot key (even the null
    key, which pandas also treats as one value) is reduced inside every input
    partition and no wide row is sorted or held by an aggregate.  Rows that
    tie in ``order`` are told apart by a digest of their content, so the row
    that stays does not depend on the layout of the input.  The chosen places
    then pick the rows in a semi join on the place, which has no hot value.
    """
    key, order = _columns(key), _columns(order)
    if not order:
        raise ValueError("an explicit order column is required for keep-first/last")
    rows = written(df.select("*", F.xxhash64(*df.columns).alias(CONTENT),
                             F.monotonically_increasing_id().alias(PLACE)), "placed-rows")
    rank = F.struct(*order, CONTENT, PLACE)
    best = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(
        (F.min(rank) if keep == "first" else F.max(rank)).alias("best"))
    return rows.join(best.select(F.col(f"best.{PLACE}").alias(PLACE)), PLACE, "left_semi").select(*df.columns)


def duplicate_count(df: DataFrame, key: Sequence[str] | str | None = None) -> DataFrame:
    """Rows that repeat an earlier row's key (pandas ``duplicated().sum()``).

    Computed as rows - distinct keys: two aggregates with map-side combine,
    no window, so a hot key costs nothing extra.
    """
    cols = df.columns if key is None else _columns(key)
    per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg((F.sum("__n") - F.count(F.lit(1))).cast("long").alias("duplicate_count"),
                       F.sum("__n").cast("long").alias("rows"))


def all_duplicates(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Every row whose key occurs more than once (``duplicated(keep=False)``).

    Null keys compare equal, as in pandas.  The input is evaluated once; keys
    are counted with map-side combine.  The repeated ones, one row each, meet
    the rows by a broadcast if they were counted to be few, otherwise
    replicated over parts to which the rows are dealt by their place: a key
    with a third of all rows is spread either way.
    """
    key = _columns(key)
    rows = written(df.select("*", F.monotonically_increasing_id().alias(PLACE)), "placed-rows")
    repeated = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"), "repeated-keys")
    return attach(rows, repeated, key, repeated.count(), PLACE).select(*df.columns)
