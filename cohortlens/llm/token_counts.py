"""Token counts from a compiled finite-state tokenizer.

A byte-pair tokenizer with word ends is turned into a deterministic
transducer over bytes.  Its state holds, for every cut position from which a
longer token can still grow, the trie node of the bytes read since, the last
token of the encoding up to the cut and the number of tokens there (relative
to now).  Reading a byte extends these threads; the longest one that spells a
token which may follow its last token gives the last token of the encoding of
all bytes read so far.  The transition is annotated with the change of the
token count, so a word's count is the sum along its path.  Tokens a, b may
stand side by side exactly if encoding their joined bytes gives (a, b); that
test and the transitions are compiled on demand and kept (up to
``MAX_STATES`` states, then compiled anew).

Texts are cut into chunks of ``CHUNK`` characters.  A chunk's state map sends
the state before it to the state after it and a count.  White space resets
the machine, so a map is given by the bytes before the first space, the count
between the first and the last, and the bytes after the last; a chunk without
a space only extends the word.  Maps compose associatively, and ``scan``
composes them pairwise in a tree.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import byte_alphabet
from .common import WHITE_SPACE, text_slices

MAX_STATES = 150_000
MAX_WORDS = 300_000
CHUNK = 1 << 16
END = 256  # added to the last byte of a word
WORD_END = "</w>"


class Transducer:
    """Deterministic transducer of a merge list; ``count`` runs a word through it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.alphabet = byte_alphabet()
        self.symbol = [0] * 512  # id of a byte, and of a byte that ends a word
        for ch, b in self.alphabet.items():
            self.symbol[b] = vocab[ch]
            self.symbol[b + END] = vocab[ch + WORD_END]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.spelling: dict[int, tuple[int, ...]] = {}
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in vocab.items():
            whole = token.endswith(WORD_END)
            body = token[:-len(WORD_END)] if whole else token
            if not body or any(c not in self.alphabet for c in body):
                continue
            spelt = [self.alphabet[c] for c in body]
            if whole:
                spelt[-1] += END
            if self.encode(spelt) == [i]:  # else no text ever gives it
                self.spelling[i] = tuple(spelt)
                self._add(spelt, i)
        self.beside: dict[tuple[int, int], bool] = {}
        self._reset()

    def _add(self, spelt: list[int], token: int) -> None:
        node = 0
        for s in spelt:
            if s not in self.child[node]:
                self.child[node][s] = len(self.child)
                self.child.append({})
                self.token_at.append(-1)
            node = self.child[node][s]
        self.token_at[node] = token

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number, self.moves = [start], {start: 0}, [{}]

    def encode(self, spelt) -> list[int]:
        """Merges in order of rank, leftmost first: what the transducer is compiled from."""
        ids = [self.symbol[s] for s in spelt]
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            ids[i:i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def _may_follow(self, a: int, b: int) -> bool:
        got = self.beside.get((a, b))
        if got is None:
            if len(self.beside) > 4 * MAX_STATES:
                self.beside.clear()
            got = self.beside[a, b] = self.encode(self.spelling[a] + self.spelling[b]) == [a, b]
        return got

    def _compile(self, state: int, s: int) -> tuple[int, int]:
        """Target and emitted-token count of the transition of ``state`` on symbol ``s``."""
        grown, last, change = [], -1, 0
        for node, before, n in self.states[state]:
            to = self.child[node].get(s)
            if to is None:
                continue
            grown.append((to, before, n))
            token = self.token_at[to]
            if last < 0 <= token and (before < 0 or self._may_follow(before, token)):
                last, change = token, n + 1
        if last < 0:
            raise ValueError(f"no encoding ends with symbol {s}")
        target = (*((node, before, n - change) for node, before, n in grown if self.child[node]), (0, last, 0))
        at = self.number.get(target)
        if at is None:
            at = self.number[target] = len(self.states)
            self.states.append(target)
            self.moves.append({})
        return at, change

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token's bytes."""
        if len(self.states) > MAX_STATES:
            self._reset()
        state, total, moves = 0, 0, self.moves
        last = len(word) - 1
        for k, s in enumerate(word):
            if k == last:
                s += END
            move = moves[state].get(s)
            if move is None:
                move = self._compile(state, s)
                moves[state][s] = move
            state = move[0]
            total += move[1]
        return total


class ChunkMap(NamedTuple):
    """What a chunk does to the machine: ``head`` ends the word before it, ``tail`` starts the next."""

    head: str
    count: int
    tail: str | None  # None: no space, the whole chunk is ``head``


class Counter:
    """Token counts of whole texts, as the tokenizers library gives for the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(model["vocab"], merges)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.spaces = re.compile(f"[{WHITE_SPACE}]+")
        self.cache: dict[str, int] = {}

    def _run(self, run: str) -> int:
        """Tokens of a run without spaces, already normalised."""
        count = self.machine.count
        return sum([count(w.encode()) for w in self.words.findall(run)])

    def _runs(self, runs: list[str]) -> int:
        cache = self.cache
        if len(cache) > MAX_WORDS:
            cache.clear()
        for r in set(runs).difference(cache):
            if len(r) <= 64:
                cache[r] = self._run(r)
        return sum([cache[r] if len(r) <= 64 else self._run(r) for r in runs])

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # lower case goes character by character: a final sigma is no exception
        return text.replace("Σ", "σ").lower()

    def chunk_map(self, chunk: str) -> ChunkMap:
        runs = self.spaces.split(chunk)
        if len(runs) == 1:
            return ChunkMap(chunk, 0, None)
        return ChunkMap(runs[0], self._runs(runs[1:-1]), runs[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return ChunkMap(a.head, a.count, a.tail + b.head)
        return ChunkMap(a.head, a.count + self._run(a.tail + b.head) + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """The composition of all maps, pairwise in a tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def _segment(self, text: str, chunk: int) -> int:
        text = self._normal(text)
        whole = self.scan([self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)] or [ChunkMap("", 0, None)])
        return self._run(whole.head) + whole.count + (self._run(whole.tail) if whole.tail else 0)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not any(s in text for s in self.special):
            return self._segment(text, chunk)
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(self._segment(p, chunk) for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text, in one pass without a shuffle.

    A null text counts as empty (0 and 0); repeated rows and null ids stay; an
    empty table gives no rows.
    """
    slim = docs.select(F.col(id_col), F.col(text_col))
    schema = StructType([StructField(id_col, slim.schema[0].dataType), StructField("n_bytes", LongType()),
                         StructField("n_tokens", LongType())])

    def run(batches):
        c = counter(path)
        for part, texts in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([c.count(t, chunk) for t in texts], pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, schema)
