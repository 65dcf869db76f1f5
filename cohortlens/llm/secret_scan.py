"""Secret scans: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick automaton over all keywords of all rules runs over the text's
bytes with ASCII letters lower-cased.  A hit names a rule and a place; only
there the rule's expression is tried, anchored at the hit, on the bytes as
they are.  Rules whose tokens embed a checksum keep a match only if it holds.

Runs of hex digits have no fixed word in them, so their keywords are all
``16 ** HEX_GRAM`` strings of ``HEX_GRAM`` hex digits: a run that long hits
at its first digit.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, StringType

from .common import text_slices

HEX_GRAM = 4
HEX_DIGITS = "0123456789abcdef"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
# Generator polynomial of bech32 (fixed values).
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BASE_KINDS = ("assign", "access", "hex")

SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def base62_crc(token: re.Match) -> bool:
    """Thirty random characters, then their crc32 in six base-62 digits."""
    body, check = token.group(1)[:30], token.group(1)[30:]
    left, digits = zlib.crc32(body.encode("latin-1")), ""
    for _ in range(6):
        left, d = divmod(left, 62)
        digits = BASE62[d] + digits
    return digits == check


def base58_check(token: re.Match) -> bool:
    """The last four bytes are the start of the body's double SHA-256."""
    number = 0
    for c in token.group():
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes(82, "big") if number.bit_length() <= 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_check(token: re.Match) -> bool:
    """The checksum over prefix and data leaves the constant 1."""
    prefix, _, data = token.group().lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            if top >> i & 1:
                check ^= step
    return check == 1


@dataclass(frozen=True)
class Rule:
    """Keywords (lower case, none inside another of the rule), the expression from there on, and the test of a match.

    ``bounded``: no letter, digit or underscore may stand before the hit.
    """

    kind: str
    keywords: tuple[str, ...]
    pattern: str
    holds: Callable[[re.Match], bool]
    flags: int = 0
    bounded: bool = False


# Kinds in the order that breaks ties of the start (patterns are fixed values).
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: m.end(2) - m.start(2) >= 6, re.IGNORECASE),
    Rule("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    Rule("hex", (), r"[0-9a-f]+", lambda m: m.end() - m.start() >= 24),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])", base62_crc,
         bounded=True),
    Rule("npm", ("npm_",), r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])", base62_crc, bounded=True),
    Rule("age", ("age-secret-key-1",), r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![A-Za-z0-9])", bech32_check, bounded=True),
    Rule("xprv", ("xprv",), r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])", base58_check, bounded=True),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.patterns = [re.compile(r.pattern, r.flags | re.ASCII) for r in rules]
        self.automaton = ahocorasick.Automaton()
        for i, rule in enumerate(rules):
            words = rule.keywords or map("".join, itertools.product(HEX_DIGITS, repeat=HEX_GRAM))
            for w in words:
                self.automaton.add_word(w, i << 8 | len(w))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, end, value) by start, then rule; code points, end exclusive; leftmost, no overlap within a kind."""
        raw = text.encode()
        # One character a byte: all keywords and patterns are ASCII, and no byte of a longer character is.
        wide, lower = raw.decode("latin-1"), raw.lower().decode("latin-1")
        ends = [0] * len(self.rules)
        found: list[tuple[int, int, int]] = []
        for last, value in self.automaton.iter(lower):
            i, start = value >> 8, last + 1 - (value & 255)
            if start < ends[i]:
                continue
            rule = self.rules[i]
            if rule.bounded and start and (wide[start - 1].isalnum() and wide[start - 1].isascii() or wide[start - 1] == "_"):
                continue
            m = self.patterns[i].match(wide, start)
            if m is None:
                continue
            ends[i] = m.end()
            if rule.holds(m):
                found.append((start, i, m.end()))
        found.sort()
        if len(raw) == len(text):
            place = {x: x for s, _, e in found for x in (s, e)}
        else:
            place, at, points = {}, 0, 0
            for x in sorted({x for s, _, e in found for x in (s, e)}):
                points += len(raw[at:x].decode())
                at, place[x] = x, points
        return [(self.rules[i].kind, place[s], place[e], wide[s:e]) for s, i, e in found]


@lru_cache(maxsize=2)
def scanner() -> Scanner:
    return Scanner()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets): the secrets of every whole text, by start and kind.

    A secret is (kind, start, end, value), start and end in code points, end
    exclusive; spans of different kinds may overlap.  A null or empty text has
    none.  Rows are not compared with each other: repeated rows and null ids
    stay as they are, an empty table gives no rows, other columns are not
    read.  A very long text is scanned in one go, in time linear in its
    length.  One pass, no shuffle.
    """
    slim = docs.select(F.col(id_col), F.col(text_col))
    empty = docs.sparkSession.createDataFrame([], f"secrets {SPAN}").schema
    schema = StructType([StructField(id_col, slim.schema[0].dataType), empty["secrets"]])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        spans = scanner().spans
        for part, texts in text_slices(batches, text_col):
            found = [[dict(zip(("kind", "start", "end", "value"), s)) for s in spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], [id_col, "secrets"])

    return slim.mapInArrow(run, schema)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by its kind in angle brackets.

    Overlapping secrets become one mask with the kind of the first.  Null texts
    stay null; all columns and rows stay, in their names and types.
    """
    def run(batches):
        spans = scanner().spans
        for part, texts in text_slices(batches, text_col):
            masked = []
            for t in texts:
                pieces, at = [], 0
                for kind, s, e, _ in spans(t):
                    if s >= at:
                        pieces += [t[at:s], f"<{kind}>"]
                    at = max(at, e)
                masked.append("".join(pieces) + t[at:])
            i = part.schema.get_field_index(text_col)
            new = pa.array([None if v is None else m for v, m in zip(part.column(i).to_pylist(), masked)], pa.string())
            yield part.set_column(i, text_col, new)

    fields = [StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema.fields]
    return docs.mapInArrow(run, StructType(fields))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
