"""Minimax contiguous partition of rows into shards by atomic group sizes.

Rows with equal text form one atomic group; groups stand in the order of the
text's 64-bit hash (two texts with one hash are simply kept together).  The
smallest capacity for which a greedy walk over the ordered groups needs no
more than ``shards`` shards is found by binary search, and the cuts are made
there, so the largest shard is as small as any contiguous partition allows.

The walk needs no list of all groups at the driver.  Sizes are summed by hash
once, in a written table in which a group of any number of copies is one row;
all later sums read that.  They are first taken over fixed ranges of the hash
(``RANGES`` of them, whatever the input).  On such sums the search gives a
lower bound (a range may be cut anywhere) and an upper bound (a range is never
cut).  Heavy ranges (over ``HEAVY`` mean ranges, or over an equal share) are
summed again by finer ranges first: the bounds are no further apart than the
largest range that may be cut, so a group of copies that isn't known as one
would leave nearly every range open.  Then ranges in which a cut can fall
between the two bounds are, until both bounds meet; no bound is below the
largest group.  Ranges that together hold no more than ``REFINED`` groups are
summed by group at once, so rounds are few.  What reaches the driver is bounded
by ``RANGES`` plus ``REFINED`` rows a round.  A cut is a hash value, so
assigning rows is a comparison, without a join.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

HASH_BITS = 64
RANGE_BITS = 14  # RANGES = 2 ** RANGE_BITS
HEAVY = 16
REFINED = 1 << 16
SLOT_BINS = 1024


class Ranges:
    """Ordered hash ranges with their sizes; a range of one hash is atomic."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)  # (lowest hash, log2 of the width, bytes, groups)
        self.at = [0, *accumulate(r[2] for r in self.rows)]
        self.total = self.at[-1]

    def atomic(self, i: int) -> bool:
        return self.rows[i][1] == 0

    def whole(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy walk that never cuts a range: index where each shard ends, or None."""
        ends, i = [], 0
        while i < len(self.rows):
            j = bisect_right(self.at, self.at[i] + capacity) - 1
            if j <= i or len(ends) == shards:
                return None
            ends.append(j)
            i = j
        return ends

    def split(self, capacity: int, shards: int) -> list[int] | None:
        """The same when a range that isn't atomic may be cut anywhere: bytes where each shard ends."""
        ends, x = [], 0
        while x < self.total:
            if len(ends) == shards:
                return None
            y = min(x + capacity, self.total)
            i = bisect_right(self.at, y) - 1
            if i < len(self.rows) and self.at[i] < y and self.atomic(i):
                y = self.at[i]
            if y <= x:
                return None
            ends.append(y)
            x = y
        return ends

    def smallest(self, feasible, shards: int, low: int) -> int:
        high = self.total
        while low < high:
            mid = (low + high) // 2
            if feasible(mid, shards) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def open_ranges(self, low: int, high: int, shards: int) -> list[int]:
        """Ranges in which some greedy walk with a capacity between the bounds may cut.

        Where cuts can be is kept as intervals.  None is inside an atomic range, so walks that
        take a large group into a shard and walks that leave it to the next have intervals apart.
        """
        large = [k for k, r in enumerate(self.rows) if r[2] > high - low and self.atomic(k)]
        found: set[int] = set()
        starts = [(0, 0)]
        for _ in range(shards - 1):
            ends = []
            for a, b in starts:
                if a + low >= self.total:
                    continue
                i, last = bisect_right(self.at, a + low) - 1, min(b + high, self.total)
                first = self.at[i]
                for k in large[bisect_left(large, i):]:
                    if self.at[k] >= last:
                        break
                    ends.append((first, self.at[k]))
                    first = self.at[k + 1]
                if first <= last:
                    ends.append((first, last))
            starts = []
            for a, b in sorted(ends):
                if starts and a <= starts[-1][1]:
                    starts[-1] = (starts[-1][0], max(b, starts[-1][1]))
                else:
                    starts.append((a, b))
            for a, b in starts:
                found.update(k for k in range(bisect_right(self.at, a) - 1, bisect_left(self.at, b)) if not self.atomic(k))
        return sorted(found)


def _lowest(width: int) -> Column:
    """Lowest hash of the range of 2**width values that a row is in."""
    return F.shiftleft(F.shiftright(F.col("h"), width), width) if width else F.col("h")


def _sums(groups: DataFrame, width: int) -> list[tuple[int, int, int, int]]:
    """Bytes and groups by hash range of 2**width values."""
    sums = groups.groupBy(_lowest(width).alias("low")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    return [(r.low, width, r.b, r.n) for r in sums.collect()]


def _within(groups: DataFrame, width: int, lows: list[int]) -> DataFrame:
    """Groups in the listed ranges (at most RANGES + REFINED), by a hash join."""
    listed = groups.sparkSession.range(1).select(
        F.explode(F.split(F.lit(",".join(map(str, lows))), ",").cast("array<long>")).alias("listed"))
    return groups.join(F.broadcast(listed), _lowest(width) == F.col("listed"), "left_semi")


def minimax_cuts(sized: DataFrame, shards: int) -> tuple[list[int], int]:
    """Lowest hash of shards 1, 2, ... (fewer if the groups are few) and the capacity.

    ``sized`` has ``h`` (long) and ``size`` (positive long) for each row.
    """
    groups = materialize(sized.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    width = HASH_BITS - RANGE_BITS
    ranges = Ranges(_sums(groups, width))
    while True:
        share = -(-ranges.total // shards)
        # Heavy ranges come first (fewer than the shards, or RANGES / HEAVY): a large group in them
        # decides the capacity or where cuts cannot be, and then the bounds are near.
        heavy = min(share, ranges.total * HEAVY >> RANGE_BITS)
        todo = [i for i, r in enumerate(ranges.rows) if r[2] > heavy and not ranges.atomic(i)]
        if not todo:
            low = ranges.smallest(ranges.split, shards, max([share, *(r[2] for r in ranges.rows if r[1] == 0)]))
            high = ranges.smallest(ranges.whole, shards, low)
            todo = [] if low == high else ranges.open_ranges(low, high, shards)
            if not todo:
                ends = ranges.whole(high, shards) or []
                return [ranges.rows[j][0] for j in ends if j < len(ranges.rows)], high
        # Finer sums of the open ranges: as fine as REFINED rows allow, by group if they hold no more.
        few = sum(ranges.rows[i][3] for i in todo) <= REFINED
        by_width: dict[int, list[int]] = {}
        for i in todo:
            by_width.setdefault(ranges.rows[i][1], []).append(ranges.rows[i][0])
        chosen = set(todo)
        rows = [r for i, r in enumerate(ranges.rows) if i not in chosen]
        for wide, lows in by_width.items():
            finer = 0 if few else max(0, wide - max(1, (REFINED // len(todo)).bit_length() - 1))
            rows += _sums(_within(groups, wide, lows), finer)
        ranges = Ranges(rows)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot): every row with its shard and place in it.

    Size is the text's UTF-8 bytes plus 1 (null text: as empty).  Equal texts
    share a shard; the largest shard is as small as the order of groups
    allows.  Slots are gapless from 0 in each shard.  Repeated rows and null
    ids get slots of their own; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = materialize(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h")), "shard-sizes")
    cuts, _ = minimax_cuts(sized, shards)
    number = F.lit(0)
    for low in cuts:
        number = number + (F.col("h") >= F.lit(low)).cast("int")
    # Slots: rows are numbered in bins dealt by their place in the written table,
    # which no group of copies can fill, and each bin starts after the bins before.
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    placed = sized.select("*", number.alias("shard"), row.alias("row")).withColumn(
        "bin", F.pmod("row", F.lit(SLOT_BINS)).cast("int"))
    counts = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("first", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("id", "h", "row")) - 1
    return (placed.withColumn("at", within)
            .join(F.broadcast(starts.select("shard", "bin", "first")), ["shard", "bin"])  # at most shards * SLOT_BINS rows
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                    "shard", (F.col("first") + F.col("at")).cast("long").alias("slot")))
