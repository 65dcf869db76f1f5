"""Conversation structure repair by dynamic programming over runs of equal rows.

A row counts by its symbol: the role's initial (s, u, a or another) with its
fault (none, truncated, or one that requires deletion).  The repaired role
initials must read ``(s?(ua)+)?``; the automaton has four states (nothing
yet, after s, after u, after a).  A symbol is a 4 x 4 min-plus matrix over
these states: the cheapest insertions, then the cheapest edit of the row.
Equal consecutive symbols are collapsed to a run, and a run advances the cost
vector through the cached binary powers of its matrix.  The costs to go then
decide the edits from the front, which gives the ASCII-least audit among the
cheapest; inside a run the costs come from halving it.

A conversation of at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` of text is
repaired by itself in a stream of rows sorted by conversation.  A longer one
is cut into blocks of consecutive rows: blocks are summed to matrices, these
are composed from the end, each block is unrolled for its four possible start
states, and the start states follow from the front.  Only the digest of the
repaired text, which is sequential by its nature, reads a whole conversation
in one task, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

BLOCK_ROWS = 20_000
BLOCK_BYTES = 64_000_000
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
INF = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
DELETED = 11  # symbol of rows that must go; the others are 3 * initial + (1 if truncated)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEXT = (USER, USER, ASSISTANT, USER)  # state after an insertion or a new role
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROW_EDITS = re.compile("I*[DKR]")

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in range(4)), INF) for j in range(4)) for i in range(4))


def apply(a: Matrix, v: Vector) -> Vector:
    """Costs to go before a step, from those after it."""
    return tuple(min(r[0] + v[0], r[1] + v[1], r[2] + v[2], r[3] + v[3], INF) for r in a)


UNIT: Matrix = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
_ONE = tuple(tuple(0 if i == j else 2 if NEXT[i] == j else INF for j in range(4)) for i in range(4))
INSERTS: Matrix = times(_ONE, times(_ONE, _ONE))  # no more than three insertions lead to new states
FINISH: Vector = apply(INSERTS, (0, INF, INF, 0))


def row_edits(symbol: int) -> list[tuple[str, int, tuple[int | None, ...]]]:
    """(initial of the edit, cost, state after it for each state before it) of a symbol, in ASCII order."""
    edits = [("D", 3, (0, 1, 2, 3))]
    if symbol != DELETED:
        initial, fault = symbol // 3, symbol % 3
        moves = KEEPS.get(INITIALS[initial:initial + 1], {})
        edits += [("K", fault, tuple(moves.get(q) for q in range(4))), ("R", 2 + fault, NEXT)]
    return edits


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """Min-plus matrix of 2**k rows of one symbol."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    row = [[INF] * 4 for _ in range(4)]
    for _, cost, to in row_edits(symbol):
        for q in range(4):
            if to[q] is not None:
                row[q][to[q]] = min(row[q][to[q]], cost)
    return times(INSERTS, tuple(map(tuple, row)))


def advance(symbol: int, count: int, after: Vector) -> Vector:
    """Costs to go before ``count`` rows of one symbol."""
    k = 0
    while count:
        if count & 1:
            after = apply(power(symbol, k), after)
        count, k = count >> 1, k + 1
    return after


def runs(symbols: Iterable[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1] = (s, out[-1][1] + 1)
        else:
            out.append((s, 1))
    return out


def block_matrix(of: list[tuple[int, int]]) -> Matrix:
    total = UNIT
    for symbol, count in reversed(of):
        columns = [advance(symbol, count, tuple(total[i][j] for i in range(4))) for j in range(4)]
        total = tuple(tuple(columns[j][i] for j in range(4)) for i in range(4))
    return total


@lru_cache(maxsize=200_000)
def row_choice(symbol: int, after: Vector, state: int) -> tuple[str, int]:
    """ASCII-least edits of one row (insertions before it included), and the state after it."""
    before, audit = apply(power(symbol, 0), after), ""
    while True:
        for name, cost, to in row_edits(symbol):
            if name != "D" and before[state] == 2 + before[NEXT[state]]:
                break  # an insertion comes before K and R
            if to[state] is not None and cost + after[to[state]] == before[state]:
                return audit + name, to[state]
        if before[state] != 2 + before[NEXT[state]]:
            raise AssertionError("no edit reaches the least cost")
        audit, state = audit + "I", NEXT[state]


def unroll_run(symbol: int, count: int, after: Vector, state: int) -> tuple[str, int]:
    if count == 1:
        least = min(after)
        return row_choice(symbol, tuple(min(x - least, INF) for x in after), state)
    late = count // 2
    early, state = unroll_run(symbol, count - late, advance(symbol, late, after), state)
    rest, state = unroll_run(symbol, late, after, state)
    return early + rest, state


def unroll(of: list[tuple[int, int]], after: Vector, state: int) -> tuple[str, int]:
    """Audit of a block from ``state``, and the state at its end."""
    goes = [after]
    for symbol, count in reversed(of):
        goes.append(advance(symbol, count, goes[-1]))
    goes.reverse()
    audit = []
    for (symbol, count), later in zip(of, goes[1:]):
        part, state = unroll_run(symbol, count, later, state)
        audit.append(part)
    return "".join(audit), state


def closing(state: int) -> str:
    """Insertions after the last row."""
    audit = ""
    while FINISH[state]:
        audit, state = audit + "I", NEXT[state]
    return audit


def symbol_of(role: str, must_go: bool, truncated: bool) -> int:
    if must_go:
        return DELETED
    return 3 * (INITIALS.index(role[0]) if role[:1] in KEEPS else len(INITIALS)) + truncated


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def replay(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """Repaired (role, text) of the rows that an audit edits."""
    rows = iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEEPS[role[:1]][state]
            yield role, text
        elif edit == "R":
            state = NEXT[state]
            yield ROLE[state], text


def repair_rows(rows: list[tuple[int | None, str, str]]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows) of sorted (turn, role, text) rows."""
    seen: set[tuple[str, str]] = set()
    symbols, blank, duplicate, truncated, illegal, last = [], 0, 0, 0, 0, None
    for _, role, text in rows:
        end = text.rstrip(BLANKS)[-1:]
        again = (role, text) in seen
        seen.add((role, text))
        cut = bool(end) and not again and end not in STOPS
        symbols.append(symbol_of(role, not end or again, cut))
        blank, duplicate, truncated = blank + (not end), duplicate + (bool(end) and again), truncated + cut
        illegal += last is not None and not legal(last, role[:1])
        last = role[:1]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    of = runs(symbols)
    audit, state = unroll(of, FINISH, START)
    audit += closing(state)
    cost = FINISH
    for symbol, count in reversed(of):
        cost = advance(symbol, count, cost)
    return gaps, blank, duplicate, truncated, illegal, cost[START], audit, list(replay([r[1:] for r in rows], audit))


def digest(lines: Iterable[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


SUMMARY = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
ORDER = ["conv", "turn", "role", "text"]


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): rows damaged by ``crc32(conv:turn) % 20``.

    0 drops the row (it stays as a mark of its conversation), 1 empties the
    text, 2 removes its ``[.!?]``, 3 repeats the row, 4 makes it the user's.
    A null counts as one space, but the turn's and conversation's own values
    stay null.
    """
    key = F.concat(*[F.coalesce(c, F.lit(" ")) for c in
                     (F.col(conv_col).cast("string"), F.lit(":"), F.col(turn_col).cast("string"))])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        (fault == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def plain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped) of rows as they are; a null role or text counts as one space."""
    return turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))


def _sorted_conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its rows) from batches sorted by conversation."""
    rows, current, started = [], None, False
    for batch in batches:
        for conv, turn, role, text, dropped in zip(*[c.to_pylist() for c in batch.columns]):
            if not started or conv != current:
                if started:
                    yield current, rows
                rows, current, started = [], conv, True
            if not dropped:
                rows.append((turn, role, text))
    if started:
        yield current, rows


def _short(rows: DataFrame, kind: str, texts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        names = ["conv", *[f.split()[0] for f in SUMMARY.split(", ")]]
        conv_type = None
        held: list[tuple] = []

        def flush():
            columns = list(zip(*held))
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def lines():
            columns = list(zip(*held))
            types = [conv_type, pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              ["conv", "place", "role", "text"])

        def typed():
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field(0).type
                yield b

        for conv, turns in _sorted_conversations(typed()):
            *figures, repaired = repair_rows(turns)
            held += ([(conv, i, r, t) for i, (r, t) in enumerate(repaired)] if texts
                     else [(conv, *figures, digest(repaired))])
            if len(held) >= 2000:
                yield lines() if texts else flush()
                held = []
        if held:
            yield lines() if texts else flush()

    ordered = rows.select(*ORDER, "dropped").repartition("conv").sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(run, f"conv {kind}, place long, role string, text string" if texts
                              else f"conv {kind}, {SUMMARY}")


def _vector(v) -> Vector:
    return tuple(int(x) for x in v)


def _long(rows: DataFrame, kind: str, texts: bool, blocks: int) -> DataFrame:
    """As ``_short``, by blocks of consecutive rows."""
    spark = rows.sparkSession
    # Blocks: ranges of the order.  The row number ends ties, so equal rows can be cut too.
    numbered = rows.where("NOT dropped").select(*ORDER, F.monotonically_increasing_id().alias("tie"))
    placed = materialize(numbered.repartitionByRange(blocks, *ORDER, "tie").sortWithinPartitions(*ORDER, "tie").select(
        *ORDER, F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq")), "turns")
    # First places of the (role, text) pairs that a conversation has more than once.
    pair = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    paired = placed.withColumn("pair", pair)
    firsts = paired.groupBy("conv", "pair").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv").alias("c"), F.col("pair").alias("p"), "first")
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    marked = paired.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pair") == F.col("p")), "left")
    marked = marked.withColumns({"end": end, "again": F.coalesce(F.col("seq") > F.col("first"), F.lit(False))})
    initial = F.substring("role", 1, 1)
    cut = (F.col("end") != "") & ~F.col("again") & ~F.col("end").isin(*STOPS)
    cls = F.coalesce(*[F.when(initial == c, F.lit(i)) for i, c in enumerate(INITIALS)], F.lit(3))
    symbol = F.when((F.col("end") == "") | F.col("again"), F.lit(DELETED)).otherwise(3 * cls + cut.cast("int"))
    marked = materialize(marked.select("conv", "block", "seq", "turn", "role", "text", initial.alias("initial"),
                                       symbol.alias("symbol"), (F.col("end") == "").alias("blank"),
                                       ((F.col("end") != "") & F.col("again")).alias("duplicate"), cut.alias("cut")), "marked")
    counts = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(F.col(c).cast("long")).alias(a) for c, a in (("blank", "blank"), ("duplicate", "duplicate"), ("cut", "truncated"))])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        firsts = rows["initial"].tolist()
        matrix = [x for r in block_matrix(runs(rows["symbol"].tolist())) for x in r]
        return pd.DataFrame({"conv": rows["conv"].iloc[:1], "block": rows["block"].iloc[:1], "matrix": [matrix],
                             "illegal": [sum(not legal(a, b) for a, b in zip(firsts, firsts[1:]))],
                             "head": firsts[:1], "tail": firsts[-1:]})

    def from_end(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        after, goes = FINISH, []
        for m in reversed(rows["matrix"].tolist()):
            goes.append(after)
            after = apply(tuple(_vector(m[4 * i:4 * i + 4]) for i in range(4)), after)
        seams = [not legal(a, b) for a, b in zip(rows["tail"].tolist(), rows["head"].tolist()[1:])]
        return pd.DataFrame({"conv": rows["conv"], "block": rows["block"], "after": goes[::-1], "cost": after[START],
                             "illegal": int(rows["illegal"].sum()) + sum(seams)})

    def unrolled(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of, after = runs(left.sort_values("seq")["symbol"].tolist()), _vector(right["after"].iloc[0])
        audits = [unroll(of, after, q) for q in range(4)]
        return pd.DataFrame({"conv": [left["conv"].iloc[0]] * 4, "block": [left["block"].iloc[0]] * 4, "start": range(4),
                             "audit": [a for a, _ in audits], "stop": [q for _, q in audits]}).astype(
                                 {"conv": left["conv"].dtype})

    def from_front(rows: pd.DataFrame) -> pd.DataFrame:
        stops = {(b, s): e for b, s, e in zip(rows["block"], rows["start"], rows["stop"])}
        state, out = START, []
        order = sorted(set(rows["block"]))
        for b in order:
            out.append((b, state, closing(stops[b, state]) if b == order[-1] else ""))
            state = stops[b, state]
        frame = pd.DataFrame(out, columns=["block", "start", "closing"])
        frame.insert(0, "conv", [rows["conv"].iloc[0]] * len(out))
        return frame.astype({"conv": rows["conv"].dtype})

    def edited(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The repaired lines of each row, with those inserted before it (the last row: also after it)."""
        left, chosen = left.sort_values("seq"), right.iloc[0]
        parts = ROW_EDITS.findall(chosen["audit"])
        parts[-1] += chosen["closing"]
        state, lines = int(chosen["start"]), []
        for part, role, text in zip(parts, left["role"], left["text"]):
            got = list(replay([(role, text)], part, state))
            for r, _ in got:
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[r[:1]]
            lines.append([{"role": r, "text": t} for r, t in got])
        return pd.DataFrame({"conv": left["conv"], "seq": left["seq"], "audit": parts, "lines": lines})

    by_block = ["conv", "block"]
    slim = marked.select("conv", "block", "seq", "symbol", "initial")
    sums = slim.groupBy(*by_block).applyInPandas(
        summed, f"conv {kind}, block int, matrix array<long>, illegal long, head string, tail string")
    goes = materialize(sums.groupBy("conv").applyInPandas(
        from_end, f"conv {kind}, block int, after array<long>, cost long, illegal long"), "costs-to-go")
    audits = materialize(slim.groupBy(*by_block).cogroup(goes.groupBy(*by_block)).applyInPandas(
        unrolled, f"conv {kind}, block int, start int, audit string, stop int"), "audits")
    starts = audits.drop("audit").groupBy("conv").applyInPandas(
        from_front, f"conv {kind}, block int, start int, closing string")
    a, s = audits.alias("a"), starts.alias("s")
    chosen = a.join(s, F.col("a.conv").eqNullSafe(F.col("s.conv")) & (F.col("a.block") == F.col("s.block"))
                    & (F.col("a.start") == F.col("s.start"))).select("a.conv", "a.block", "a.start", "a.audit", "s.closing")
    lines = marked.select("conv", "block", "seq", "role", "text").groupBy(*by_block).cogroup(
        chosen.groupBy(*by_block)).applyInPandas(
            edited, f"conv {kind}, seq long, audit string, lines array<struct<role:string,text:string>>")
    lines = materialize(lines, "repaired").repartition("conv").sortWithinPartitions("conv", "seq")

    def hashed(batches: Iterator[pa.RecordBatch]):
        current, started, audit, h, empty, kind_ = None, False, [], None, True, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([current], kind_), pa.array(["".join(audit)]), pa.array([h.hexdigest()])],
                ["conv", "audit", "repaired_sha256"])

        for batch in batches:
            kind_ = batch.schema.field(0).type
            for conv, part, new in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not started or conv != current:
                    if started:
                        yield row()
                    current, started, audit, h, empty = conv, True, [], hashlib.sha256(), True
                audit.append(part)
                for x in new:
                    h.update((("" if empty else "\n") + f"{x['role']}:{x['text']}").encode())
                    empty = False
        if started:
            yield row()

    def spread(batches: Iterator[pa.RecordBatch]):
        current, place, started = None, 0, False
        for batch in batches:
            out = []
            for conv, new in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if not started or conv != current:
                    current, place, started = conv, 0, True
                for x in new:
                    out.append((conv, place, x["role"], x["text"]))
                    place += 1
            if out:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 ["conv", "place", "role", "text"])

    if texts:
        return lines.mapInArrow(spread, f"conv {kind}, place long, role string, text string")
    hashes = lines.mapInArrow(hashed, f"conv {kind}, audit string, repaired_sha256 string")
    figures = goes.groupBy("conv").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    c, g, x = counts.alias("c"), figures.alias("g"), hashes.alias("x")
    return c.join(g, F.col("c.conv").eqNullSafe(F.col("g.conv"))).join(x, F.col("c.conv").eqNullSafe(F.col("x.conv"))).select(
        "c.conv", "c.gaps", "c.blank", "c.duplicate", "c.truncated", "g.illegal", "g.cost", "x.audit", "x.repaired_sha256")


def _repair(rows: DataFrame, texts: bool, block_rows: int, block_bytes: int) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()
    sizes = rows.groupBy("conv").agg(F.sum((~F.col("dropped")).cast("long")).alias("n"),
                                     F.sum(F.octet_length("text")).alias("bytes"))
    big = materialize(sizes.where((F.col("n") > block_rows) | (F.col("bytes") > block_bytes) & (F.col("n") > 1)), "long-conversations")
    total = big.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("c")).first()
    if not total["c"]:
        return _short(rows, kind, texts)
    names = big.select(F.col("conv").alias("big"))
    same = F.col("conv").eqNullSafe(F.col("big"))
    short = _short(rows.join(names, same, "left_anti"), kind, texts)
    blocks = 2 * max(-(-total["n"] // block_rows), -(-total["bytes"] // block_bytes))
    return short.unionByName(_long(rows.join(names, same, "left_semi"), kind, texts, blocks))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    ``rows`` come from ``plain`` or ``damage``: (conv, turn, role, text,
    dropped).  A conversation's rows stand by turn (nulls first), then role
    and text, so ties have one order; all rows with a null conversation form
    one.  The first of these faults of a row counts: blank (only white space),
    duplicate (role and text seen earlier in it), truncated (does not end in
    ``.``, ``!`` or ``?``).  Edits: Keep 0, Rerole to user or assistant 2,
    Delete 3 (required for blank and duplicate rows), Insert an empty turn of
    user or assistant 2; a truncated row that stays adds 1.  ``audit`` has the
    edits' initials, the ASCII-least of the cheapest.  A conversation without
    rows (all dropped) has zeros, an empty audit and the digest of the empty
    string; an empty table gives no rows; further columns are not read.
    Conversations and texts may be of any length (see the module).
    """
    return _repair(rows, False, block_rows, block_bytes)


def repaired_turns(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv, place, role, text): the repaired conversations; places are gapless from 0.  Cases as in ``repair``."""
    return _repair(rows, True, block_rows, block_bytes)
