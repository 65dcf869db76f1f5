"""Percentile-based outlier trimming."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.quantiles import column_quantiles


def trim_outliers(df: DataFrame, upper: Mapping[str, float], lower: Mapping[str, float] | None = None,
                  null_ok: Iterable[str] = ()) -> DataFrame:
    """Keep rows strictly inside discrete-percentile limits.

    ``upper={col: p}`` keeps ``col < PERCENTILE_DISC(p)``; ``lower`` keeps
    ``col > PERCENTILE_DISC(p)``.  A null passes only for columns listed in
    ``null_ok`` (otherwise SQL's null comparison drops the row).

    All limits are computed in one pass (columns unpivoted); the result is a
    single row of numbers used as literals, so the filter is a narrow
    predicate over the input with no shuffle of the input rows.
    """
    lower = dict(lower or {})
    null_ok = set(null_ok)
    cols = sorted(set(upper) | set(lower))
    probs = {}
    for c, p in upper.items():
        probs[f"hi_{c}"] = p
    for c, p in lower.items():
        probs[f"lo_{c}"] = p
    uniq = {f"q{i}": p for i, p in enumerate(sorted(set(probs.values())))}
    name_of = {p: n for n, p in uniq.items()}
    lim = column_quantiles(df, cols, uniq, kind="disc")
    lim = lim.select(*[F.col(f"{c}_{name_of[p]}").alias(f"__hi_{c}") for c, p in upper.items()],
                     *[F.col(f"{c}_{name_of[p]}").alias(f"__lo_{c}") for c, p in lower.items()])
    # The limits are one row of len(upper) + len(lower) numbers: fetched once
    # as literals (a bounded scalar result, not data), so every downstream
    # branch filters against the same values without re-running the
    # percentile passes, and the predicates can be pushed like constants.
    row = lim.first().asDict()
    j = df
    cond = F.lit(True)
    for c in cols:
        inside = F.lit(True)
        if c in upper:
            inside = inside & (F.col(c) < F.lit(row[f"__hi_{c}"]))
        if c in lower:
            inside = inside & (F.col(c) > F.lit(row[f"__lo_{c}"]))
        if c in null_ok:
            inside = inside | F.col(c).isNull()
        cond = cond & F.coalesce(inside, F.lit(False))
    return j.where(cond).select(*df.columns)
