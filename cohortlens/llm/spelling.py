"""Spelling variants by a variable-length gram index.

1. Words are counted over all texts.  Each word gets a start and an end mark.
2. Gram dictionary: grams of 2 to ``LONGEST`` characters are counted over the
   words.  A gram is frequent if it occurs more than ``total / FREQUENT``
   times; so a length has fewer than ``FREQUENT`` frequent grams, whatever the
   input, and only these are sent to the tasks.  The dictionary of level q
   has the grams that are not frequent but whose shorter beginnings are, and
   what is still frequent at q characters or at the end mark.
3. Decomposition: at every place exactly one gram of the dictionary begins.
   Grams that lie inside an earlier one are left out.
4. Affected grams: a gram is chosen by its own characters alone, so one edit
   at i can only take away a gram that ends in i .. i + q - 1 (one that holds
   i, or one that a changed earlier gram could now cover).  The most such ends
   over all i is the word's bound B.  Of n grams at least n - B stand in every
   near word, at the same place or, beyond an insertion, at the next.
5. List merging: by a fixed order of grams, rarest first, the first preserved
   gram is among the first B + 1 of both words.  Only these are listed, under
   (gram, place, length), and lists of one key are joined.  Words of c and
   c + 1 characters meet in class c, which starts at level (c + 2) / 2.  A
   word whose bound leaves no gram (n <= B) is listed whole and again at the
   next shorter level, down to bigrams, where at least five grams always stay.
6. Joined words are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, text_slices

LONGEST = 6
FREQUENT = 20_000
MIN_LENGTH = 6
FLUSH = 200_000
FIRST, LAST = "^", "$"  # marks; no letters
LETTERS = "[A-Za-zÀ-ÿ]"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = 5, misspell: int | None = None) -> DataFrame:
    """(word, n): letter runs of whole texts, A-Z lower-cased, with at least ``min_length`` code points and ``min_count`` occurrences.

    ``misspell`` plants errors: where it divides h, the crc32 of
    ``<id>:<run>``, the run's code point h modulo its length is deleted.  A
    null text has no runs, a null id is written as nothing.  Repeated rows
    count each time.  Texts of any length are read in parts; counts are summed
    in the tasks before the shuffle.
    """
    runs = re.compile(f"{LETTERS}{{{min_length},}}")
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()),
                                              pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for part, texts in text_slices(batches, "text"):
            for name, text in zip(part.column(0).to_pylist(), texts):
                prefix = zlib.crc32(f"{name or ''}:".encode())
                found = (m.group() for m in runs.finditer(text)) if len(text) > 1_000_000 else iter(runs.findall(text))
                while piece := Counter(islice(found, FLUSH)):
                    for raw, n in piece.items():
                        word = raw.encode().lower()  # of bytes: ASCII letters alone
                        if misspell and (h := zlib.crc32(word, prefix)) % misspell == 0:
                            letters = word.decode()
                            at = h % len(letters)
                            word = (letters[:at] + letters[at + 1:]).encode()
                        total[word] += n
                    if len(total) > FLUSH:
                        yield flush()
        if total:
            yield flush()

    counted = slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def frequent_grams(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT) -> dict[str, int]:
    """Counts of the frequent grams of the marked words: fewer than ``frequent`` of each length reach the driver."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                             ["gram", "n"])
            total.clear()
            return out

        for batch in batches:
            for word in batch.column(0).to_pylist():
                w = FIRST + word + LAST
                for q in range(2, longest + 1):
                    total.update([w[p:p + q] for p in range(len(w) - q + 1)])
                if len(total) > FLUSH:
                    yield flush()
        if total:
            yield flush()

    grams = materialize(words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(
        F.sum("n").alias("n")), "grams")
    length = F.char_length("gram")
    totals = {r.q: r.n for r in grams.groupBy(length.alias("q")).agg(F.sum("n").alias("n")).collect()}
    limit = F.coalesce(*[F.when(length == q, F.lit(max(1, n // frequent))) for q, n in totals.items()], F.lit(1))
    return {r.gram: r.n for r in grams.where(F.col("n") > limit).collect()}


def decompose(marked: str, q: int, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """(gram, place) of the level's dictionary, without grams inside an earlier one."""
    out, reach, size = [], 0, len(marked)
    for p in range(size - 1):
        end = p + 2
        while end < p + q and end < size and marked[p:end] in frequent:
            end += 1
        if end > reach:
            out.append((marked[p:end], p))
            reach = end
            if end == size:
                break
    return out


def affected(grams: list[tuple[str, int]], q: int) -> int:
    """Most grams that one edit can take away."""
    ends = [p + len(g) - 1 for g, p in grams]  # ascending
    most, first = 0, 0
    for k, e in enumerate(ends):
        while ends[first] < e - q + 1:
            first += 1
        most = max(most, k - first + 1)
    return most


def signature(marked: str, q: int, frequent: dict[str, int]) -> list[tuple[int, str, int]]:
    """(level, gram, place) to list a word under, from level ``q`` down to the first whose bound leaves a gram."""
    out = []
    while True:
        grams = decompose(marked, q, frequent)
        bound = affected(grams, q)
        grams.sort(key=lambda g: (frequent.get(g[0], 0), g))
        out += [(q, g, p) for g, p in grams[:bound + 1]]
        if len(grams) > bound:
            return out
        q -= 1


def list_keys(length: int, level: int, gram: str, place: int) -> int:
    """Key of a list: a collision joins words that verification parts again."""
    return zlib.crc32(gram.encode()) << 20 | (length & 0xFF) << 12 | (place & 0x1FF) << 3 | level


def level_of(length: int, longest: int = LONGEST) -> int:
    return min(longest, (length + 2) // 2)


def listed(words: DataFrame, frequent: dict[str, int], longest: int = LONGEST) -> DataFrame:
    """(word, n, here, longer): keys of each word among words of its length, and as the longer word of a pair."""
    grams = words.sparkSession.sparkContext.broadcast(frequent)  # fewer than longest * FREQUENT short strings

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.value
        for batch in batches:
            here, longer = [], []
            for word in batch.column(0).to_pylist():
                c, w = len(word), FIRST + word + LAST
                q = level_of(c, longest)
                own = signature(w, q, known)
                below = own if level_of(c - 1, longest) == q else signature(w, level_of(c - 1, longest), known)
                here.append([list_keys(c, *x) for x in own])
                # A gram behind the insertion stands one place earlier in the shorter word.
                longer.append([list_keys(c - 1, l, g, p - d) for l, g, p in below for d in (0, 1) if p >= d])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(here, kind), pa.array(longer, kind)],
                                             ["word", "n", "here", "longer"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, here array<long>, longer array<long>")


def near_pairs(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """(a, n_a, b, n_b): each pair of the words (word, n) with edit distance 1 once.

    Words are distinct and have at least ``MIN_LENGTH`` code points.  No list
    or pair is left out; a long list is joined by Spark's sort-merge join,
    which spills and splits skewed partitions.
    """
    index = materialize(listed(words, frequent_grams(words, longest, frequent), longest), "gram-lists")
    left = index.select(F.explode("here").alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = index.select(F.explode("here").alias("k"), F.col("word").alias("b"), F.col("n").alias("n_b"),
                         F.lit(True).alias("same")).unionByName(
        index.select(F.explode("longer").alias("k"), F.col("word").alias("b"), F.col("n").alias("n_b"),
                     F.lit(False).alias("same")))
    met = (F.col("key") == F.col("k")) & (~F.col("same") | (F.col("a") < F.col("b")))
    return left.join(right, met & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame, ratio: int = 5, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counted words (word, n), as from ``word_counts``.

    Two words are near at edit distance 1 (code points).  A word's form is the
    near word of the largest n (ties: smallest in code-point order) if that is
    at least ``ratio`` times (2 or more) the word's own; its root is the end
    of the chain of forms.  Without a form: form and form_n null, root the
    word.  An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or chains of forms need not end")
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words, longest, frequent), "near-words")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    # A word has at most as many near words as it has edits, so no group is hot.
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    enough = -F.col("best.order") >= ratio * F.col("n")
    formed = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")), "forms")
    # Chains double each round; n grows by the ratio with each step, so their length is bounded by the largest n.
    steps, most = 0, formed.agg(F.max("form_n")).first()[0] or 0
    while most >= ratio:
        steps, most = steps + 1, most // ratio
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for k in range(max(0, steps - 1).bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), f"roots-{k}")
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
