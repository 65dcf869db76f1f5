"""Value counts of a numeric column with a rank index: quantiles, moments, ranks.

``Distribution`` evaluates its input once: (group, value) counts are
aggregated (a hot value is one row) and written to the session's checkpoint
folder.  Everything else reads those counts.

* rank -> value.  A first index sums the counts by cells: 64 to an e-fold of
  the value, the same for every group, so no task holds a group and no join
  is needed.  A cell that holds a wanted rank is summed again by finer cells
  between its least and largest value, or value by value once it has at most
  ``SMALL`` of them; the others are never read again.  A group has at most
  about 90,000 cells, a refined cell ``SMALL``, whatever the input.
* value -> rank.  Counts on both sides of given points come from one
  aggregate over the counts.
* moments.  Count and sum are exact (decimal); squares are taken of the
  differences to the mean, so nothing cancels.

Small tables (one row a group, or a cell with a wanted rank) meet the counts
by a broadcast only after their rows were counted; larger ones are replicated
over ``SALT`` parts, so a group or cell with a third of all values is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators.scalar import with_scalars
from cohortlens.session import written

SMALL = 4096
FANOUT = 1024
SALT = 32
BROADCAST_ROWS = 10_000
PER_E_FOLD = 64
HIT = "struct<off:bigint,cell:struct<b:double,n:bigint,d:bigint,lo:double,hi:double>>"
X = "CAST(__v AS DOUBLE)"


def probabilities(probs: Mapping[str, float] | Sequence[float]) -> dict[str, float]:
    """Column name -> fraction; a list gets names like ``p25``."""
    if isinstance(probs, Mapping):
        return {str(k): float(v) for k, v in probs.items()}
    return {f"p{int(round(p * 100)):02d}" if p * 100 == int(p * 100) else f"p{p}": float(p) for p in probs}


def names(*columns: str) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where null keys are equal; ``right`` has one row if there are no keys."""
    if not keys:
        return with_scalars(left, right)
    same = F.expr(" AND ".join(f"l.`{k}` <=> r.`{k}`" for k in keys))
    return left.alias("l").join(right.alias("r"), same, how).select(
        "l.*", *[f"r.`{c}`" for c in right.columns if c not in keys])


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], most: int, deal: str = "__v") -> DataFrame:
    """``rows`` joined with a table of at most ``most`` rows (as counted), few of them for each key.

    Broadcast up to ``BROADCAST_ROWS`` rows; beyond, the table is replicated
    over ``SALT`` parts and the rows dealt to them by the column ``deal``.
    """
    if not keys:
        return with_scalars(rows, table)
    if most <= BROADCAST_ROWS:
        return null_safe(rows, F.broadcast(table), keys)
    salted = rows.selectExpr("*", f"CAST(pmod(xxhash64({deal}), {SALT}) AS INT) AS __salt")
    parts = table.selectExpr("*", f"explode(sequence(0, {SALT - 1})) AS __salt")
    return null_safe(salted, parts, [*keys, "__salt"]).drop("__salt")


# Number of a double's first cell: ascending, the same for all groups (null: null).  The logarithm is monotone, so
# cells are ranges; NaN, the largest value, has a cell to itself.
FIRST_CELL = (f"CASE WHEN isnan({X}) THEN 1e6D WHEN __v IS NOT NULL THEN CAST(floor(least(greatest("
              f"signum({X}) * log1p(abs({X})), -720D), 720D) * {PER_E_FOLD}) AS DOUBLE) END")


def _holding(rank: str) -> str:
    """(off, cell): the cell of the sorted ``cells`` that holds a 1-based rank, and the counts before it."""
    return (f"aggregate(cells, named_struct('off', 0L, 'hit', CAST(NULL AS {HIT})), (a, c) -> named_struct("
            f"'off', a.off + c.n, 'hit', CASE WHEN a.off < {rank} AND a.off + c.n >= {rank} "
            f"THEN named_struct('off', a.off, 'cell', c) ELSE a.hit END), a -> a.hit)")


def _ranks(kind: str, p: float) -> dict[str, str]:
    """1-based ranks among ``total`` values that a quantile is made of."""
    if kind == "disc":
        return {"lo": f"greatest(1L, CAST(ceil({p!r}D * total) AS BIGINT))"}
    return {w: f"CAST({f}({p!r}D * (total - 1)) AS BIGINT) + 1" for w, f in (("lo", "floor"), ("hi", "ceil"))}


class Distribution:
    """Counts of the values of ``value`` in each ``by`` group; null values are counted apart."""

    def __init__(self, counts: DataFrame, by: Sequence[str]):
        self.counts, self.by = counts, list(by)  # (*by, __v, __c)
        self._index: DataFrame | None = None
        self._groups: int | None = None

    @classmethod
    def of(cls, df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> Distribution:
        v = F.col(value) if isinstance(value, str) else value
        counts = df.select(*by, v.alias("__v")).groupBy(*by, "__v").agg(F.expr("count(1) AS __c"))
        return cls(written(counts, "value-counts"), by)

    @classmethod
    def of_counts(cls, df: DataFrame, value: str, count: str, by: Sequence[str] = ()) -> Distribution:
        """From a frame that has counts already."""
        counts = df.groupBy(*by, F.col(value).alias("__v")).agg(F.sum(count).alias("__c"))
        return cls(written(counts, "value-counts"), by)

    def where(self, condition: Column | str) -> Distribution:
        """The part whose values (``__v``) meet a condition, without reading the input again."""
        return Distribution(self.counts.where(condition), self.by)

    def _grouped(self, df: DataFrame, keys: Sequence[str], *aggregates: str) -> DataFrame:
        return df.groupBy(*keys).agg(*map(F.expr, aggregates))

    def groups(self) -> int:
        """Number of groups, counted up to where it no longer matters."""
        if self._groups is None:
            self._groups = (self.index().select(*self.by).distinct().limit(BROADCAST_ROWS + 1).count() if self.by else 1)
        return self._groups

    def index(self, keep: bool = True) -> DataFrame:
        """(by, b, n, d, lo, hi, s, f): rows, distinct values, range, exact and floating sum of each first cell.

        The exact sum is null where a value or the sum is beyond decimals (or not finite).
        """
        if self._index is None:
            cells = self._grouped(
                self.counts.selectExpr(*map(names, self.by), "__v", "__c", f"{X} AS x", f"{FIRST_CELL} AS b",
                                       "try_cast(__v AS DECIMAL(28,6)) AS exact"), [*self.by, "b"],
                "sum(__c) AS n", "count(1) AS d", "min(x) AS lo", "max(x) AS hi",
                "CASE WHEN count(__v) = count(exact) THEN try_sum(try_multiply(exact, CAST(__c AS DECIMAL(18,0)))) END AS s",
                "sum(x * __c) AS f")
            if not keep:
                return cells
            self._index = written(cells, "value-cells")
        return self._index

    def moments(self) -> DataFrame:
        """(by, count, mean, std, min, max); std with n - 1, null for one value; groups without values have count 0."""
        sums = self._grouped(self.index(), self.by, "coalesce(sum(CASE WHEN b IS NOT NULL THEN n END), 0L) AS count",
                             "CASE WHEN count(b) = count(s) THEN try_sum(s) END AS s", "sum(f) AS f", "min(lo) AS min",
                             "max(hi) AS max")
        sums = sums.selectExpr(*map(names, self.by), "count",
                               "try_divide(coalesce(CAST(s AS DOUBLE), f), CAST(count AS DOUBLE)) AS mean", "min", "max")
        rows = attach(self.counts.where("__v IS NOT NULL"), sums.select(*self.by, "mean"), self.by, self.groups())
        spread = self._grouped(rows.selectExpr(*map(names, self.by), "__c", f"{X} - mean AS off"), self.by,
                               "sum(__c * off) AS e", "sum(__c * off * off) AS ee")
        return null_safe(sums, spread, self.by, "left").selectExpr(
            *map(names, self.by), "count", "mean",
            "CASE WHEN count > 1 THEN sqrt(greatest(ee - e * e / count, 0D) / (count - 1)) END AS std", "min", "max")

    def quantiles(self, probs: Mapping[str, float] | Sequence[float], kind: str = "cont", out_type: str = "double",
                  total: str | None = None) -> DataFrame:
        """(by, one column for each probability); a group without values has no row.

        ``total`` names a further column with the number of values.
        """
        if kind not in ("cont", "disc"):
            raise ValueError("kind must be 'cont' or 'disc'")
        wanted, by = probabilities(probs), list(map(names, self.by))
        cells = self._grouped(self.index(keep=False).where("b IS NOT NULL"), self.by,
                              "array_sort(collect_list(struct(b, n, d, lo, hi))) AS cells", "sum(n) AS total")
        ranks = [f"named_struct('q', {i}, 'w', '{w}', 'k', {k}, 'h', {_holding(k)})"
                 for i, p in enumerate(wanted.values()) for w, k in _ranks(kind, p).items()]
        hits = written(cells.selectExpr(*by, "total", f"inline(array({', '.join(ranks)}))").selectExpr(
            *by, "total", "q", "w", "k", "h.off", "h.cell.b", "h.cell.d", "h.cell.lo", "h.cell.hi").where("lo IS NOT NULL"),
            "ranks")
        found = []
        while True:
            found.append(hits.where("lo = hi"))
            hits = hits.where("lo < hi")
            size = hits.selectExpr("count(1) AS n", "max(d) AS d").first()
            if not size["n"]:
                break
            hits = self._refined(hits, size["n"])
            if size["d"] <= SMALL:  # value by value: nothing stays open
                found.append(hits)
                break
            hits = written(hits, "ranks")
        values = reduce(DataFrame.unionByName, found)
        out = []
        for i, (q, p) in enumerate(wanted.items()):
            low, high = (f"max(CASE WHEN q = {i} AND w = '{w}' THEN lo END)" for w in ("lo", "hi"))
            h = f"({p!r}D * (max(total) - 1))"
            v = low if kind == "disc" else f"{low} + ({high} - {low}) * ({h} - floor({h}))"
            out.append(f"CAST({v} AS {out_type}) AS `{q}`")
        return self._grouped(values, self.by, *out, *([f"max(total) AS `{total}`"] if total else []))

    def _refined(self, hits: DataFrame, most: int) -> DataFrame:
        """Open ranks (``most`` of them) moved to a finer cell."""
        by, cell = list(map(names, self.by)), [*self.by, "b", "low", "high"]
        hits = hits.selectExpr(*by, "total", "q", "w", "k", "off", "b", "d", "lo AS low", "hi AS high")
        open_cells = self._grouped(hits, cell, "max(d) AS values")
        rows = self.counts.where("__v IS NOT NULL").selectExpr(*by, "__v", "__c", f"{X} AS x", f"{FIRST_CELL} AS b")
        inside = attach(rows, open_cells, [*self.by, "b"], most).where("x BETWEEN low AND high")
        finer = self._grouped(inside.selectExpr(
            *map(names, cell), "__c", "x", f"CASE WHEN values <= {SMALL} THEN x ELSE "
            f"CAST(least(floor((x - low) / (high - low) * {FANOUT}), {FANOUT - 1}) AS DOUBLE) END AS part"), [*cell, "part"],
            "sum(__c) AS n", "count(1) AS d", "min(x) AS lo", "max(x) AS hi")
        cells = self._grouped(finer, cell, "array_sort(collect_list(named_struct("
                              "'b', part, 'n', n, 'd', d, 'lo', lo, 'hi', hi))) AS cells")
        moved = null_safe(hits, cells, cell).selectExpr(*by, "total", "q", "w", "k", "off", "b", f"{_holding('(k - off)')} AS h")
        return moved.selectExpr(*by, "total", "q", "w", "k", "off + h.off AS off", "b", "h.cell.d", "h.cell.lo", "h.cell.hi")

    def around(self, points: DataFrame, lower: str, upper: str) -> DataFrame:
        """Value to rank: ``points`` (one row a group) with what lies inside and outside of two of its columns.

        Adds ``below`` and ``above`` (rows outside), ``up_to`` (rows not above
        ``upper``), ``inner_low`` and ``inner_high`` (outermost values inside).
        """
        points = written(points, "points")
        ends = points.selectExpr(*map(names, self.by), f"`{lower}` AS a", f"`{upper}` AS z")
        sides = attach(self.counts.where("__v IS NOT NULL"), ends, self.by, self.groups())
        sides = self._grouped(
            sides.selectExpr(*map(names, self.by), "__c", "a", "z", f"{X} AS x"), self.by,
            "sum(CASE WHEN x < a THEN __c ELSE 0 END) AS below", "sum(CASE WHEN x > z THEN __c ELSE 0 END) AS above",
            "sum(CASE WHEN x <= z THEN __c ELSE 0 END) AS up_to", "min(CASE WHEN x >= a THEN x END) AS inner_low",
            "max(CASE WHEN x <= z THEN x END) AS inner_high")
        return null_safe(points, sides, self.by, "left")
