"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability in a language is the sum, over all its segmentations
into pieces, of the product of their probabilities; the forward recursion

    forward[j] = sum over pieces that end at j of forward[j - len] * p(piece)

gives it without listing them.  A text's log probability is the sum over its
words, and the posterior under equal priors decides.  The piece probabilities
are fitted by expectation maximisation: forward and backward give each
piece's expected count in the words of a language.  Words of equal length are
handled together as matrices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import materialize, text_slices

WORD = re.compile(r"[^\W\d_]+")
START = "▁"  # marks a word's beginning in the vocabulary
MAX_WORD = 24  # a longer word is scored in parts of that many letters
MAX_PIECE = 8
MAX_CACHE = 250_000
UNKNOWN = 1e-7  # a character that is no piece
MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    """Lower-case words with their start mark, none over ``MAX_WORD`` letters."""
    out = []
    for w in WORD.findall(text.lower()):
        if len(w) <= MAX_WORD:
            out.append(START + w)
        else:
            out += [START + w[:MAX_WORD], *(w[i:i + MAX_WORD] for i in range(MAX_WORD, len(w), MAX_WORD))]
    return out


class Vocabulary:
    """Pieces of a sentencepiece file that words can contain: the mark and letters, up to ``MAX_PIECE`` long."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
                  and 0 < len(p := sp.id_to_piece(i).lower()) <= MAX_PIECE
                  and all(c.isalpha() for c in p.removeprefix(START))}
        self.pieces = sorted(pieces)
        keys = np.array([self._key(p) for p in self.pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        # The table's high bits lead to a key's place without a search, but for a few.
        self.bits = 20
        self.table = np.full(1 << self.bits, -1, np.int32)
        slots = (self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.table[slots[::-1]] = self.ids[::-1]  # the first of a slot's keys
        self.key_of = np.append(keys, np.uint64(0))
        first = self.table[slots]
        self.rest = np.sort(self.keys[self.key_of[first] != self.keys])
        self.rest_ids = self.ids[np.searchsorted(self.keys, self.rest)]

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h ^ ord(c)) * int(MIX)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h * int(MIX) & 0xFFFFFFFFFFFFFFFF

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of keys; the number of pieces where there is none."""
        key = h * MIX
        got = self.table[(key >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.where((got >= 0) & (self.key_of[got] == key), got, len(self.pieces))
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, key), len(self.rest) - 1)
            out = np.where(self.rest[at] == key, self.rest_ids[at], out)
        return out

    def lattice(self, words: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, piece number of each word) for words of one length."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
        out = []
        for start in range(n):
            h = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(start + MAX_PIECE, n) + 1):
                h = (h ^ codes[:, end - 1]) * MIX
                h ^= h >> np.uint64(29)
                out.append((start, end, self.lookup(h)))
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _with_unknown(probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows for "no piece": as a longer part (0), and as a single character."""
    width = probability.shape[1]
    return (np.vstack([probability, np.zeros((1, width))]), np.vstack([probability, np.full((1, width), UNKNOWN)]))


def forward(lattice: list, n: int, tables: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """forward[j]: (words, languages) sums over the segmentations of the first j characters."""
    size = len(lattice[0][2])
    f = [np.ones((size, tables[0].shape[1]))] + [np.zeros((size, tables[0].shape[1])) for _ in range(n)]
    for start, end, piece in lattice:  # in the order of start
        f[end] += f[start] * tables[end == start + 1][piece]
    return f


def expected_counts(lattice: list, n: int, tables: tuple, weight: np.ndarray, pieces: int) -> np.ndarray:
    """Expected occurrences of each piece, (pieces, languages), over words with ``weight`` occurrences."""
    f = forward(lattice, n, tables)
    b = [np.zeros_like(f[0]) for _ in range(n)] + [np.ones_like(f[0])]
    for start, end, piece in reversed(lattice):
        b[start] += b[end] * tables[end == start + 1][piece]
    scale = weight / f[n]
    out = np.zeros((pieces + 1, f[0].shape[1]))
    for start, end, piece in lattice:
        share = f[start] * tables[end == start + 1][piece] * b[end] * scale
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(piece, share[:, k], pieces + 1)
    return out[:-1]


@dataclass
class Model:
    path: str
    languages: list[str]
    probability: np.ndarray  # (pieces, languages)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        v, tables = vocabulary(self.path), _with_unknown(self.probability.astype(float))
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            for k in range(0, len(at), 4096):
                part = at[k:k + 4096]
                out[part] = np.log(forward(v.lattice([words[i] for i in part]), n, tables)[n])
        return out


def _sample(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str, max_docs: int,
            max_chars: int) -> DataFrame:
    """(lang, text) of about ``max_docs`` documents a language, by a hash of the id."""
    usable = docs.where(allowed & F.col(lang_col).isNotNull() & (F.char_length(text_col) <= max_chars)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    share = {r["lang"]: min(1.0, max_docs / r["count"]) for r in usable.groupBy("lang").count().collect()}
    if not share:
        return usable.select("lang", "text").limit(0)
    cut = F.create_map(*[x for lang, part in share.items() for x in (F.lit(lang), F.lit(int(part * (1 << 32))))])
    return usable.where(F.pmod("h", F.lit(1 << 32)) < F.element_at(cut, F.col("lang"))).select("lang", "text")


def train(docs: DataFrame, allowed: Column, path: str, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", rounds: int = 3, max_docs: int = 1_500, max_chars: int = 100_000,
          smoothing: float = 0.05) -> Model:
    """Model from a bounded sample of the rows with a language for which ``allowed`` holds.

    About ``max_docs`` documents of each language, by a hash of the id, none
    over ``max_chars`` characters.  Words are counted by language on the
    cluster, and each round of expectation maximisation is one job over those
    counts that returns a number for each language and piece met.
    """
    v = vocabulary(path)
    texts = _sample(docs, allowed, id_col, text_col, lang_col, max_docs, max_chars)

    def words_of(batches):
        for part, rows in text_slices(batches, "text"):
            lang = part.column(0).to_pylist()
            for x, t in zip(lang, rows):
                words, n = np.unique(np.array(split_words(t), object), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(words), pa.string()), pa.array(words, pa.string()),
                                                  pa.array(n, pa.int64())], ["lang", "word", "n"])

    counts = materialize(texts.mapInArrow(words_of, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")), "langid-words")
    languages = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    size = len(v.pieces)
    probability = np.full((size, max(len(languages), 1)), 1.0 / size)

    def expect(batches):
        tables = _with_unknown(probability)
        total = np.zeros(probability.shape)
        for batch in batches:
            lang, word, n = (c.to_pylist() for c in batch.columns)
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(word):
                by_length.setdefault(len(w), []).append(i)
            for length, at in by_length.items():
                for k in range(0, len(at), 4096):
                    part = at[k:k + 4096]
                    weight = np.zeros((len(part), len(languages)))
                    weight[np.arange(len(part)), [languages.index(lang[i]) for i in part]] = [n[i] for i in part]
                    total += expected_counts(vocabulary(path).lattice([word[i] for i in part]), length, tables, weight, size)
        piece, lang_at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang_at, pa.int64()), pa.array(piece, pa.int64()),
                                          pa.array(total[piece, lang_at], pa.float64())], ["k", "piece", "c"])

    for _ in range(rounds if languages else 0):
        rows = counts.mapInArrow(expect, "k long, piece long, c double").groupBy("k", "piece").agg(F.sum("c").alias("c")).collect()
        total = np.full(probability.shape, smoothing)
        for r in rows:
            total[r["piece"], r["k"]] += r["c"]
        probability = total / total.sum(0)
    return Model(path, languages, probability.astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of every whole text and its posterior.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if no language was learned.  A tie goes to the first language in
    alphabetical order.  Repeated rows and null ids stay.
    """
    slim = docs.select(F.col(id_col), F.col(text_col))
    schema = StructType([StructField(id_col, slim.schema[0].dataType), StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])

    def run(batches):
        place: dict[str, int] = {}
        scores = np.zeros((0, len(model.languages)))
        for part, texts in text_slices(batches, text_col):
            words = [split_words(t) if any(c.isalpha() for c in t) else [] for t in texts]
            if len(place) > MAX_CACHE:
                place.clear()
                scores = scores[:0]
            new = [w for w in {w for ws in words for w in ws} if w not in place]
            place.update(zip(new, range(len(place), len(place) + len(new))))
            scores = np.vstack([scores, model.word_scores(new)])
            langs, best = [], []
            for ws in words:
                if not ws or not model.languages:
                    langs.append("und")
                    best.append(0.0)
                    continue
                total = scores[[place[w] for w in ws]].sum(0)
                k = int(total.argmax())
                langs.append(model.languages[k])
                best.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(best, pa.float64())],
                                             [id_col, "lang_pred", "score"])

    return slim.mapInArrow(run, schema)
