"""Byte-level BPE encoding and decoding with a contiguous rank array.

Words of the same byte length are encoded together: one matrix holds their
parts, a second one the merge ranks of adjacent parts.  Each step scans every
row for its smallest rank, deletes that boundary and refreshes the ranks on
both sides, so all live rows lose exactly one column.  Rows without a
mergeable pair are done.  Words over ``SHORT_WORD`` bytes would make the scan
quadratic; they use a heap over a linked list with the same result.

Results are those of the tokenizers library for the same file, without
truncation, padding or added tokens; special tokens' strings inside a text
become their single id, as is that library's default.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import text_slices

SHORT_WORD = 64
CACHE_WORDS = 500_000
NO_MERGE = np.int32(2**31 - 1)

# Pre-token pattern of the byte-level tokenizers, with the commonest branch
# first and possessive runs; the branches start differently, so the order
# does not matter.
PATTERN = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.byte_ids = np.zeros(256, np.int32)
        for ch, b in alphabet.items():
            self.byte_ids[b] = vocab[ch]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.merged = keys[order], order.astype(np.int32), made
        self.pair_rank = dict(zip(keys.tolist(), range(len(keys))))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_MERGE)

    def _equal_length(self, words: list[bytes], n: int) -> list[bytes]:
        """Ids (little-endian uint32) of words of ``n`` bytes each."""
        out: list[bytes] = [b""] * len(words)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)]
        who = np.arange(len(words))
        rank = self.ranks(ids[:, :-1], ids[:, 1:]) if n > 1 else np.empty((len(words), 0), np.int32)
        while len(who):
            width = ids.shape[1]
            at = rank.argmin(1) if width > 1 else np.zeros(len(who), np.int64)
            best = rank[np.arange(len(who)), at] if width > 1 else np.full(len(who), NO_MERGE)
            done = best == NO_MERGE
            if done.any():
                flat = ids[done].astype("<u4").tobytes()
                for k, w in enumerate(who[done].tolist()):
                    out[w] = flat[4 * width * k: 4 * width * (k + 1)]
                live = ~done
                ids, rank, who, at, best = ids[live], rank[live], who[live], at[live], best[live]
                if not len(who):
                    break
            rows = np.arange(len(who))
            ids[rows, at] = self.merged[best]
            # delete the boundary behind part `at`
            col = np.arange(width - 1)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
            col = np.arange(width - 2)
            rank = np.take_along_axis(rank, col + (col >= at[:, None]), 1)
            # refresh the neighbouring ranks
            has = at > 0
            rank[rows[has], at[has] - 1] = self.ranks(ids[rows[has], at[has] - 1], ids[rows[has], at[has]])
            has = at < width - 2
            rank[rows[has], at[has]] = self.ranks(ids[rows[has], at[has]], ids[rows[has], at[has] + 1])
        return out

    def _long_word(self, word: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, pair_rank, merged = len(ids), self.pair_rank, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair_rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the parts was merged meanwhile
            ids[i], ids[j] = int(merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (r := pair_rank.get(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raw)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            got = [self._long_word(raw[i]) for i in at] if n > SHORT_WORD else self._equal_length([raw[i] for i in at], n)
            for i, ids in zip(at, got):
                out[i] = ids
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(words.difference(self.cache))
        self.cache.update(zip(new, self.encode_words(new)))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        find = self.words.findall
        parts: list[list] = []
        for t in texts:
            if any(s in t for s in self.special):
                parts.append([self.special[s] if k % 2 else find(s) for k, s in enumerate(self.split_special.split(t))])
            else:
                parts.append([find(t)])
        self._learn({w for doc in parts for x in doc if not isinstance(x, int) for w in x})
        look = self.cache.__getitem__
        return [b"".join([x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(look, x)) for x in doc])
                for doc in parts]

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        look = self.token_bytes
        return b"".join([look[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): every whole text encoded; ids as little-endian uint32.

    A null text counts as empty (no ids).  One pass over the input partitions,
    no shuffle; repeated rows and null ids stay as they are.
    """
    slim = docs.select(F.col(id_col), F.col(text_col))
    schema = StructType([StructField(id_col, slim.schema[0].dataType), StructField("n_tokens", LongType()),
                         StructField("ids", BinaryType())])

    def run(batches):
        bpe = tokenizer(path)
        for part, texts in text_slices(batches, text_col):
            ids = bpe.encode_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                [id_col, "n_tokens", "ids"])

    return slim.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of ``ids_col`` (null ids: null)."""
    rest = [c for c in encoded.columns if c != "decoded"]
    frame = encoded.select(*rest)
    schema = StructType([*frame.schema.fields, StructField("decoded", StringType())])

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [None if x is None else bpe.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*rest, "decoded"])

    return frame.mapInArrow(run, schema)
