"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

1. Every text becomes the set of its five-word shingles and a signature of
   ``TREES`` trees with ``DEPTH`` minimum hashes each.  Texts that are equal
   form one class and go on as one.
2. In each tree the signatures stand in a prefix trie: two texts meet at
   depth k of a tree if their first k hashes agree.  A pair of similarity s
   meets in some tree with probability 1 - (1 - s^k)^TREES.  Matching starts
   with the longest prefixes; found links, each weighted by the inverse of
   its probability of being found, estimate how many links there are, and the
   prefixes are shortened until the estimated share of links found reaches
   the target in every similarity bin with links, whatever their number (at ``FLOOR`` even a pair right at the threshold misses with
   less than 1 in 10,000).
3. Texts that share a trie node are brought together under the node's least
   text, whole sets once for each such hub; a hub with many texts is cut into
   blocks and each pair of blocks is compared by itself.  Intersections are
   counted exactly from the shingles.  A block pair returns one row per text:
   its links and the least text it is linked with, never the pairs.
4. Linked texts are closed to groups by passing on the least label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, maybe_among, placed, text_slices

NGRAM = 5
TREES = 20
DEPTH = 6
FLOOR = 4
TARGET = 0.9995
BLOCK = 192
BLOCK_SHINGLES = 2_000_000
BLOCK_ROWS = 2  # of texts with more shingles than a block should have
BINS = 20
COLUMNS = 4096
WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)
FACTORS = (np.random.default_rng(20).integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))


def shingles(words: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-grams of word hashes.

    Fewer than ``n`` words make one shingle of all of them; none make none.
    """
    if not len(words):
        return words
    n = min(n, len(words))
    h = words[:len(words) - n + 1].copy()
    for i in range(1, n):
        h ^= h >> np.uint64(32)
        h = h * ODD + words[i:len(words) - n + 1 + i]
    h ^= h >> np.uint64(31)
    h *= ODD
    h ^= h >> np.uint64(29)
    return np.unique(h)


def text_shingles(texts: list[str]) -> list[np.ndarray]:
    words = [WORD.findall(t.lower()) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array(flat, object), categorize=False) if flat else np.zeros(0, np.uint64)
    return [shingles(h) for h in np.split(hashes, ends[:-1])]


def signature(shingle: np.ndarray) -> np.ndarray:
    """``TREES`` x ``DEPTH`` minimum hashes."""
    low = (shingle >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        best = np.minimum(best, (low[i:i + 1024, None] * FACTORS).min(0))
    return best.reshape(TREES, DEPTH)


def found_probability(similarity, depth: int):
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** TREES


def next_depth(histogram: np.ndarray, middles: np.ndarray, depth: int, target: float = TARGET) -> int:
    """Depth to go on with after links were counted by similarity at ``depth``; the same one: enough.

    Every bin with a link has to reach the target by itself, and all bins
    together, where one without a link counts half as much; how many links a
    bin has doesn't matter, so no large group hides the others' bins.
    """
    if depth <= FLOOR:
        return depth
    seen = histogram > 0
    there = np.where(seen, 1.0, 0.5) / found_probability(middles, depth)
    for k in range(depth, FLOOR, -1):
        found = found_probability(middles, k)
        if (found[seen] >= target).all() and (there * found).sum() >= target * there.sum():
            return k
    return FLOOR


def compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One block pair: rows (hub, rid, hubs, left, right, set) to links.

    ``left`` and ``right`` say on which side of the pair a text is (both, in
    the pair of a block with itself).  Returns, for texts with a link here,
    the least text of their group in this pair, the number of links counted
    here (a pair of texts counts under the least hub that both have) and how
    many of them lie in each similarity bin.
    """
    rows = rows.drop_duplicates("rid").sort_values("rid", kind="stable").reset_index(drop=True)
    m, sets = len(rows), [np.frombuffer(x, np.uint64) for x in rows["set"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    column = np.unique(flat, return_inverse=True)[1]
    shared = np.bincount(column)[column] > 1  # the others are in no intersection
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    # Products of 0/1 matrices, COLUMNS shingles at a time, count exactly.
    common = np.zeros((m, m), np.float32)
    ends = np.searchsorted(column, np.arange(0, len(flat) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > a:
            x = np.zeros((m, int(column[b - 1]) - k * COLUMNS + 1), np.float32)
            x[owner[a:b], column[a:b] - k * COLUMNS] = 1
            common += x @ x.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    left, right = rows["left"].to_numpy(bool), rows["right"].to_numpy(bool)
    linked = (1000 * common >= round(1000 * threshold) * union) & ((left[:, None] & right) | (right[:, None] & left))
    np.fill_diagonal(linked, False)
    label = np.arange(m)
    while True:
        least = np.minimum(label, np.where(linked, label, m).min(1))
        if (least == label).all():
            break
        label = least
    # pairs that also meet under a lesser hub are counted there
    hub = rows["hub"].iloc[0]
    lesser = [[x for x in h if x < hub] for h in rows["hubs"]]
    names = {x: i for i, x in enumerate({x for h in lesser for x in h})}
    if names:
        x = np.zeros((m, len(names)), np.float32)
        x[np.repeat(np.arange(m), [len(h) for h in lesser]), [names[y] for h in lesser for y in h]] = 1
        counted = linked & (x @ x.T == 0)
    else:
        counted = linked
    i, j = np.nonzero(counted)
    place = np.minimum((common[i, j] / union[i, j] - threshold) / (1 - threshold) * BINS, BINS - 1).astype(int)
    bins = np.zeros((m, BINS), np.int64)
    np.add.at(bins, (i, place), 1)
    keep = linked.any(1)
    return pd.DataFrame({"rid": rows["rid"].to_numpy()[keep], "label": rows["rid"].to_numpy()[label[keep]],
                         "links": counted.sum(1)[keep], "bins": pd.Series(bins[keep].tolist(), dtype=object)})


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, text, digest, file, row): ``docs`` with names that can't clash."""
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    return placed(docs).select("doc", F.col("doc")[id_col].alias("id"), text.alias("text"),
                               F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), "file", "row")


def represent(rows: DataFrame) -> DataFrame:
    """(rid, digest, id, file, row, copies, n, sig): the first row of each distinct text, in the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_slices(batches, "text"):
            sets = text_shingles(texts)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([signature(x).astype("<u4").tobytes() for x in sets], pa.binary())],
                ["id", "digest", "file", "row", "n", "sig"])

    kind = rows.schema["id"].dataType.simpleString()
    signed = rows.select("id", "digest", "file", "row", "text").mapInArrow(
        run, f"id {kind}, digest binary, file string, row long, n long, sig binary")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row", "n", "sig"))
    one = signed.groupBy("digest").agg(first.alias("r"), F.count(F.lit(1)).alias("copies"))
    return materialize(one.select(F.monotonically_increasing_id().alias("rid"), "digest", "copies", "r.id", "r.file",
                                  "r.row", "r.n", "r.sig"), "jaccard-texts")


def _hubs(texts: DataFrame, depth: int) -> DataFrame:
    """(rid, hubs): the least text of every trie node at ``depth`` that the text shares with others."""
    width = 4 * DEPTH
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(
        t, F.substring("sig", t * width + 1, F.lit(4 * depth))))
    nodes = texts.where("n > 0").select("rid", F.explode(trees).alias("node"))
    shared = nodes.groupBy("node").agg(F.min("rid").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("node", "hub")
    return nodes.join(shared, "node").groupBy("rid").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))


def _blocks(texts: Column, shingled: Column) -> Column:
    """Number of blocks for a hub's texts and their shingles: bounded by rows and by bytes."""
    by_size = F.least(F.ceil(shingled / BLOCK_SHINGLES), F.ceil(texts / BLOCK_ROWS))
    return F.greatest(F.ceil(texts / BLOCK), by_size).cast("int")


def _links(rows: DataFrame, texts: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(rid, label, links, bins) of all texts linked with one that shares a trie node at ``depth``."""
    members = materialize(_hubs(texts, depth).join(texts.select("rid", "file", "row", "n"), "rid"), "jaccard-members")
    places = members.select("rid", "hubs", F.col("file").alias("at_file"), F.col("row").alias("at_row"))
    marked = maybe_among(rows.select("text", "file", "row"), members, ["file", "row"]).where("__hit")
    with_text = marked.join(places, (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))).select(
        "rid", "hubs", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        for part, rows in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1),
                                              pa.array([x.tobytes() for x in text_shingles(rows)], pa.binary())],
                                             ["rid", "hubs", "set"])

    sets = with_text.mapInArrow(run, "rid long, hubs array<bigint>, set binary")
    # A hub's texts in blocks of about BLOCK, or fewer of long texts, every two
    # blocks (and each by itself) in a group of their own.
    sizes = members.select(F.explode("hubs").alias("hub"), "n").groupBy("hub").agg(
        _blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    placed = sets.select("*", F.explode("hubs").alias("hub")).join(sizes, "hub")
    placed = placed.withColumn("b", F.pmod(F.xxhash64("rid", "hub"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("hub", "rid", "hubs", "set", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"),
                           (F.col("b") <= F.col("other")).alias("left"), (F.col("b") >= F.col("other")).alias("right"))
    found = placed.groupBy("hub", "i", "j").applyInPandas(lambda rows: compare(rows, threshold),
                                                          "rid long, label long, links long, bins array<bigint>")
    return materialize(found, "jaccard-links")


def close_groups(edges: DataFrame) -> DataFrame:
    """(rid, label): least member of every connected group, for texts with an edge (a, b).

    Alternating large and small stars; every round is one written table.
    """
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                        "jaccard-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join can split a text with many neighbours
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "jaccard-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").where("a != b").distinct(), "jaccard-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("rid"), F.col("b").alias("label"))
        state = now


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
             target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` and (digest, label, keep, members, copies, n_links, text_class) of every distinct text.

    ``keep`` is the row that stands for the class: the least id, then file and row.
    """
    rows = _rows(docs, id_col, text_col)
    texts = represent(rows)
    middles = threshold + (np.arange(BINS) + 0.5) / BINS * (1 - threshold)
    depth = DEPTH
    while True:
        links = _links(rows, texts, depth, threshold)
        row = links.agg(*[F.coalesce(F.sum(F.col("bins")[i]), F.lit(0)).alias(f"b{i}") for i in range(BINS)]).first()
        shorter = next_depth(np.array(row, float), middles, depth, target)
        if shorter == depth:
            break
        depth = shorter
    groups = close_groups(links.select(F.col("rid").alias("a"), F.col("label").alias("b")))
    counts = links.groupBy("rid").agg(F.sum("links").alias("n_links"))
    classed = texts.select("rid", "digest", "id", "file", "row", "copies").join(groups, "rid", "left").join(
        counts, "rid", "left").select("digest", "id", "file", "row", "copies", F.coalesce("label", "rid").alias("label"),
                                      F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classed = materialize(classed, "jaccard-classes")
    names = classed.groupBy("label").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")).alias("keep"), F.sum("copies").alias("members"))
    return rows, classed.join(names, "label").select("digest", "label", "keep", "members", "copies", "n_links",
                                                     F.col("id").alias("text_class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    target: float = TARGET) -> DataFrame:
    """(id, class_id, copies, n_links, text_class) of every row.

    ``class_id`` is the least id among all rows whose texts hang together by
    links or are equal, ``text_class`` the least id of equal texts, ``copies``
    their number, and ``n_links`` the number of other texts with a Jaccard
    similarity of at least ``threshold``.  Words are runs of letters, digits
    and underscores, in lower case; a text of fewer than five words is one
    shingle.  A text without words, null included, is linked with none but is
    in one class with its equals.  Null ids come after all others (a class of
    null ids only has a null class_id); repeated rows are copies; an empty
    table gives no rows.
    """
    rows, texts = classify(docs, id_col, text_col, threshold, target)
    return rows.select(F.col("id").alias(id_col), "digest").join(texts, "digest").select(
        id_col, F.col("keep.id").alias("class_id"), "copies", "n_links", "text_class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their class, all columns as they were."""
    rows, texts = classify(docs, id_col, text_col, threshold)
    several = texts.where("members > 1").select("digest", "keep")
    marked = maybe_among(rows, several, ["digest"])
    alone = marked.where(~F.col("__hit")).select("doc.*")
    tried = marked.where("__hit").join(several, "digest", "left").where(
        "keep IS NULL OR (file = keep.file AND row = keep.row)").select("doc.*")
    return alone.unionByName(tried)
