"""Order-preserving packing of tokenised documents into fixed windows.

The documents of a partition, in their order, form one token stream (each
document's ids and then ``end_id``).  Cuts are chosen among document ends
(free), sentence ends and, inside sentences longer than ``grid`` tokens,
every ``grid``-th token, so that padding plus truncation penalties is least
over the whole stream.  With boundaries b[0] < b[1] < ... the least cost of a
stream cut at b[j] is

    f[j] = penalty[j] + max_tokens - b[j] + min(f[i] + b[i]),   b[j] - b[i] <= max_tokens

and the minimum over the sliding range of i comes from a monotone queue, so a
stream of n boundaries takes O(n) steps.  Streams are solved in blocks of
about ``block_tokens`` tokens, which bounds memory; only a block's last
window can be short for lack of text.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .bpe import byte_alphabet
from .common import text_slices

# Same pre-tokens as the tokenizers file's own pattern (possessive runs).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Tokens:
    """Ids of the tokenizers file, and which ids end a sentence or start a word."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        text = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in text.items()},
                                         special_tokens=special)
        size = max([*text, *special.values()]) + 1
        self.ends, self.starts = np.zeros(size, bool), np.zeros(size, bool)
        for i, t in text.items():
            self.ends[i] = t.rstrip(b" ").endswith((b".", b"!", b"?", b"\n")) and t.strip(b" ") != b""
            self.starts[i] = t[:1].isspace()

    def encode(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def best_cuts(bounds: np.ndarray, penalty: np.ndarray, max_tokens: int) -> np.ndarray:
    """Cheapest cut positions, first and last bound included.

    ``bounds`` ascends strictly with gaps of at most ``max_tokens``.
    """
    b, pen = bounds.tolist(), penalty.tolist()
    n = len(b)
    came, queue, value = [0] * n, deque([0]), [b[0]] * n  # value[i] = f[i] + b[i]
    for j in range(1, n):
        at = b[j]
        while b[queue[0]] < at - max_tokens:
            queue.popleft()
        i = queue[0]
        came[j] = i
        v = value[j] = value[i] + max_tokens + pen[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(b[j])
        j = came[j]
    return np.array([b[0], *cuts[::-1]], np.int64)


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, starts: np.ndarray,
                   sentence_penalty: int, truncation_penalty: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (0 first, stream's end last) and the penalty of a cut at each."""
    n = len(ids)
    kind = np.zeros(n + 1, np.int8)
    kind[1:n][ends[ids[:-1]] & starts[ids[1:]]] = 2
    kind[doc_ends] = 1
    kind[doc_ends - 1] = np.where(kind[doc_ends - 1] == 1, 1, 0)  # never between a text and its end id
    kind[0] = 1
    at = np.flatnonzero(kind)
    gap = np.diff(at)
    long = np.flatnonzero(gap > grid)
    for start, size in zip(at[long].tolist(), gap[long].tolist()):
        kind[start + grid: start + size: grid] = 3
    at = np.flatnonzero(kind)
    return at, np.array([0, 0, sentence_penalty, truncation_penalty])[kind[at]]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, max_tokens: int = 1024,
         end_id: int = 0, sentence_penalty: int = 2, truncation_penalty: int = 8, grid: int = 16,
         block_tokens: int = 1 << 20, order_by: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence.

    Columns: id, ``start`` and ``length`` in the document's ids, ``doc_tokens``
    (with the end id), ``sequence_id``, ``offset`` in the sequence, ``cut``
    (what ends the piece: document, sentence or inside) and ``ids``
    (little-endian uint32).  The order kept is that of the input partitions,
    or of ``order_by`` after one range shuffle.  A null or empty text has the
    end id only; repeated rows and null ids are packed like any other row; an
    empty table gives no rows.  ``sequence_id`` holds the partition's number
    and the window's number in it.
    """
    if not 1 <= grid <= max_tokens:
        raise ValueError("grid must lie between 1 and max_tokens")
    frame = docs
    if order_by is not None:
        frame = docs.repartitionByRange(order_by).sortWithinPartitions(order_by)
    slim = frame.select(F.col(id_col), F.col(text_col))
    id_type = slim.schema[0].dataType
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "cut", "ids"]
    kinds = [id_type, *[LongType()] * 5, StringType(), BinaryType()]
    schema = StructType([StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches):
        tok = tokens(path)
        first = TaskContext.get().partitionId() << 32

        def flush(doc_ids, arrays):
            nonlocal first
            ids = np.concatenate(arrays)
            doc_at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
            bounds, penalty = candidate_cuts(ids, doc_at[1:], tok.ends, tok.starts, sentence_penalty,
                                             truncation_penalty, grid)
            cuts = best_cuts(bounds, penalty, max_tokens)
            edges = np.union1d(doc_at, cuts)
            start, end = edges[:-1], edges[1:]
            doc = np.searchsorted(doc_at, start, "right") - 1
            seq = np.searchsorted(cuts, start, "right") - 1
            kind = penalty[np.searchsorted(bounds, end)]
            cut = pa.array(np.where(kind == 0, "document", np.where(kind == sentence_penalty, "sentence", "inside")))
            size = np.diff(doc_at)
            for k in range(0, len(start), 5_000):
                s = slice(k, k + 5_000)
                lo = int(start[s][0])
                raw = ids[lo:int(end[s][-1])].astype("<u4")
                offsets = (np.append(start[s], end[s][-1]) - lo).astype(np.int32) * 4
                pieces = pa.Array.from_buffers(pa.binary(), len(start[s]), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(doc[s])), *[pa.array(x[s], pa.int64()) for x in (
                        start - doc_at[doc], end - start, size[doc], first + seq, start - cuts[seq])],
                     cut.slice(k, len(start[s])), pieces], names)
            first += len(cuts) - 1

        held, arrays, count = [], [], 0
        for part, texts in text_slices(batches, text_col):
            held.append(part.column(0))
            for t in texts:
                ids = np.append(tok.encode(t), np.uint32(end_id))
                arrays.append(ids)
                count += len(ids)
            if count >= block_tokens:
                yield from flush(pa.concat_arrays(held), arrays)
                held, arrays, count = [], [], 0
        if arrays:
            yield from flush(pa.concat_arrays(held), arrays)

    return slim.mapInArrow(run, schema)
