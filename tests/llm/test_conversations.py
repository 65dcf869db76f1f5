"""Conversation repair: edits by exhaustive search, blocks against whole conversations, the query against a plain version."""

import functools
import hashlib
import random
import zlib

import pytest

from cohortlens.llm import conversations as C
from cohortlens.llm.catalog import op12_conversations

WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, audit, repaired) over all edit sequences of (initial, must_go, truncated, role, text) rows."""
    goes = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    then = {"": "u", "s": "u", "a": "u", "u": "a"}

    @functools.lru_cache(None)
    def best(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            c, a, out = best(i, then[last], inserted + 1)
            options.append((c + 2, "I" + a, ((then[last], None),) + out))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            c, a, out = best(i + 1, last, 0)
            options.append((c + 3, "D" + a, out))
            if not must_go:
                to = goes.get(initial, {}).get(last)
                if to:
                    c, a, out = best(i + 1, to, 0)
                    options.append((c + truncated, "K" + a, (("", i),) + out))
                c, a, out = best(i + 1, then[last], 0)
                options.append((c + 2 + truncated, "R" + a, ((then[last], i),) + out))
        return min(options, key=lambda o: o[:2]) if options else (10 ** 9, "", ())

    return best(0, "", 0)


def plain_repair(rows):
    """The contract, read plainly, for sorted (turn, role, text) rows."""
    seen, marked, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in rows:
        core = text.strip(WS)
        again, empty = (role, text) in seen, not core
        cut = not empty and not again and core[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, truncated = blank + empty, duplicate + (again and not empty), truncated + cut
        marked.append((role[:1], empty or again, int(cut)))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, out = cheapest(tuple(marked))
    names = {"u": "user", "a": "assistant"}
    lines = [(rows[i][1] if not to else names[to], rows[i][2]) if i is not None else (names[to], "") for to, i in out]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, truncated,
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        copies = {0: 0, 3: 2}.get(fault, 1)
        out.setdefault(conv, []).extend([(turn, "user" if fault == 4 else role, text)] * copies)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rs in out.items()}


def made_rows(seed=4, conversations=60):
    rng = random.Random(seed)
    texts = ["Hello.", "And?", "no end", "", " \n", "Same.", "x" * 30 + "!", "é.", None, "a ", "q. \t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "uncle"]
    rows = []
    for c in [None, *range(conversations)]:
        for t in range(rng.randint(0, 14)):
            turn = rng.choice([t, t, t, t + 3, None])
            rows.append((c, turn, rng.choice(roles if rng.random() < .5 else roles[:2]), rng.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def made(spark):
    rows = made_rows()
    return rows, spark.createDataFrame(rows, SCHEMA)


def as_dict(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def test_least_edits_by_exhaustive_search():
    rng = random.Random(1)
    for _ in range(3000):
        kinds = [0, 1, 3, 4, 6, 7, 9, 10, C.DELETED]
        symbols = []
        for _ in range(rng.randint(0, 6)):
            symbols += [rng.choice(kinds)] * rng.choice([1, 1, 2, 5])
        of = C.runs(symbols)
        audit, state = C.unroll(of, C.FINISH, C.START)
        cost = C.FINISH
        for symbol, count in reversed(of):
            cost = C.advance(symbol, count, cost)
        rows = tuple(("?", True, 0) if s == C.DELETED else ("sua?"[s // 3], False, s % 3) for s in symbols)
        assert (cost[C.START], audit + C.closing(state)) == cheapest(rows)[:2]


def test_powers_equal_single_steps():
    for symbol in (0, 4, 6, 9, C.DELETED):
        one = C.FINISH
        for n in range(1, 70):
            one = C.apply(C.power(symbol, 0), one)
            assert C.advance(symbol, n, C.FINISH) == one


def test_a_very_long_run():
    audit, state = C.unroll([(3, 200_000)], C.FINISH, C.START)  # user turns only
    # delete or rerole? every second turn reroled is cheapest
    assert audit.count("K") == audit.count("R") == 100_000 and not C.closing(state)


def test_repair_of_damaged_rows(made):
    rows, frame = made
    want = {c: plain_repair(rs) for c, rs in plain_damage(rows).items()}
    assert as_dict(C.repair(C.damage(frame))) == want


@pytest.mark.parametrize("block_rows", [13])
def test_blocks_equal_whole_conversations(made, block_rows):
    _, frame = made
    damaged = C.damage(frame)
    assert as_dict(C.repair(damaged, block_rows=block_rows)) == as_dict(C.repair(damaged))
    whole, blocks = (sorted(map(repr, C.repaired_turns(damaged, block_rows=n).collect())) for n in (100, block_rows))
    assert whole == blocks


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!", "", f"{t}."])) for t in range(3000)]
    rows += [(c, t, "user", "x.") for c in range(2, 40) for t in range(2)]
    frame = C.plain(spark.createDataFrame(rows, SCHEMA))
    assert as_dict(C.repair(frame, block_rows=500)) == as_dict(C.repair(frame))


def test_repaired_turns_read_legally(made):
    _, frame = made
    spoken = {}
    for r in C.repaired_turns(C.damage(frame)).orderBy("conv", "place").collect():
        spoken.setdefault(r.conv, []).append((r.place, r.role[:1]))
    for turns in spoken.values():
        assert [p for p, _ in turns] == list(range(len(turns)))
        roles = "".join(r for _, r in turns)
        assert roles.removeprefix("s") == "ua" * (len(roles.removeprefix("s")) // 2) and len(roles) > 1


def test_empty_tables_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damage(none)).count() == 0 and C.repaired_turns(C.damage(none)).count() == 0
    gone = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = C.repair(C.damage(spark.createDataFrame(gone, SCHEMA))).collect()
    assert len(got) == len(gone) > 5
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_clashing_names_and_key_types(spark):
    rows = [("a", 1, "user", "hi.", "x", True), ("a", 2, "assistant", "yo.", "y", None)]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, conv string, dropped boolean")
    got = C.repair(C.plain(frame)).collect()
    assert [(r.conv, r.audit) for r in got] == [("a", "KK")]


def test_query_against_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    want = {c: plain_repair(rs) for c, rs in plain_damage(rows).items()}
    assert as_dict(op12_conversations(spark, "/root/testdata/sf0.001")) == want
