import collections
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import jaccard

DATA = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    """(id, class_id, copies, n_links, text_class) of (id, text) rows, all pairs compared."""
    by_text = collections.defaultdict(list)
    for d, t in rows:
        by_text[t or ""].append(d)
    texts = list(by_text)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    sets = [shingle_set(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[root(i)] = root(j)
    members = collections.defaultdict(list)
    for i, t in enumerate(texts):
        members[root(i)] += by_text[t]
    at = {t: i for i, t in enumerate(texts)}
    return [(d, least(members[root(at[t or ""])]), len(by_text[t or ""]), links[at[t or ""]], least(by_text[t or ""]))
            for d, t in rows]


def near_copies(rng, n_base=12, copies=25, length=120):
    vocabulary = ["w%d" % i for i in range(3000)]
    rows = []
    for b in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [192, 7])
def test_links_and_classes_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(random.Random(12))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sum(w[3] for w in want) > 1000
    assert {tuple(r)[:2] for r in got} == {w[:2] for w in want}
    found, there = sum(r.n_links for r in got), sum(w[3] for w in want)
    assert there * 0.999 <= found <= there


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    given = [(1, 100), (1000, 500_000), (200, 300_000_000), (10, 10_000_000), (3, 9_000_000)]
    frame = spark.createDataFrame(given, "m long, n long")
    got = {r.m: r.b for r in frame.select("m", jaccard._blocks(F.col("m"), F.col("n")).alias("b")).collect()}
    assert got == {1: 1, 1000: 6, 200: 100, 10: 5, 3: 2}
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 500)
    rows = near_copies(random.Random(7), n_base=2, copies=20)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r)[:2] for r in found} == {w[:2] for w in brute(rows)}


def test_given_documents_and_edges(spark, small_docs, edge):
    for frame in (small_docs, edge):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = jaccard.near_duplicates(frame).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_one_row_of_each_class_stays(spark, edge, nothing):
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    classes = {r[1] for r in brute([(r.doc_id, r.text) for r in edge.collect()])}
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, classes))
    assert all(r.digest == "d" and r.label == 7 for r in rows)
    assert jaccard.keep_one(nothing).collect() == [] and jaccard.near_duplicates(nothing).collect() == []


def test_depth_shortens_until_the_target():
    middles = 0.8 + (np.arange(jaccard.BINS) + 0.5) / jaccard.BINS * 0.2
    high, low = np.zeros(jaccard.BINS), np.zeros(jaccard.BINS)
    high[-1], low[0] = 1e6, 1e6
    assert jaccard.next_depth(high, middles, jaccard.DEPTH) == jaccard.DEPTH
    assert jaccard.FLOOR <= jaccard.next_depth(low, middles, jaccard.DEPTH) < jaccard.DEPTH
    assert jaccard.next_depth(low, middles, jaccard.FLOOR) == jaccard.FLOOR
    assert jaccard.found_probability(0.8, jaccard.FLOOR) > 0.9999


def test_a_hot_group_does_not_hide_a_borderline_bin():
    middles = 0.8 + (np.arange(jaccard.BINS) + 0.5) / jaccard.BINS * 0.2
    alone = np.zeros(jaccard.BINS)
    alone[0] = 2
    hot = alone.copy()
    hot[-1] = 1e9
    depth = jaccard.next_depth(hot, middles, jaccard.DEPTH)
    assert depth == jaccard.next_depth(alone, middles, jaccard.DEPTH) < jaccard.DEPTH
    assert jaccard.found_probability(middles[0], depth) >= jaccard.TARGET


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for common in (300, 700, 900):
        pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        a, b = pool[:1000], pool[1000 - common:2000 - common]
        true = common / (2000 - common)
        same = np.mean([(jaccard.signature(a * np.uint64(k)) == jaccard.signature(b * np.uint64(k))).mean() for k in (1, 3, 5, 7, 9, 11)])
        assert abs(same - true) < 0.06


def test_groups_close_over_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.rid: r.label for r in jaccard.close_groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


# --- pipeline ---------------------------------------------------------------

def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r.doc_id: r.text for r in docs.collect()}
            assert after.items() <= before.items() and docs.count() == len(after)
            counts.append(len(after))
            if name == "exact_dedup":
                assert set(after) == set({t: d for d, t in sorted(before.items())}.values())
            if name == "ngram_jaccard":
                assert set(after) == {r[1] for r in brute(list(before.items()))}
        else:
            assert {r.doc_id for r in docs.collect()} == set(before)
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] and counts[2] > counts[3]


def test_run_by_brute_force_with_a_certified_cutoff(spark, tmp_path):
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + ("." if k % 5 == 4 else "") for k in range(n))
    texts = [prose(30) for _ in range(1800)]
    labels = [(i, 1, 0) for i in range(1800)]
    for i in range(200):
        texts.append(prose(30) + " You vilein.")
        labels.append((len(texts) - 1, 1, 1))
    for i in range(60):
        texts.append(prose(30) + " " + "#" * (20 + i % 3))
        labels.append((len(texts) - 1, 0, 0))
    near = texts[3].split(" ")
    texts += [prose(30) + " " + "#" * 30, prose(30) + " #", prose(19), None, texts[5], texts[5], " ".join(near[:-1] + ["other"]),
              prose(30) + " vileins stay away.", prose(100_000)]
    assert len(texts[-1]) > 200_000
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def symbols(t):
        return 1000 * t.count("#") // len(re.sub(r"\s", "", t))

    cutoff = min(symbols(texts[i]) for i, good, _ in labels if not good)
    stay = {i: t for i, t in enumerate(texts) if t and len(t.split()) >= 20 and symbols(t) < cutoff and "vilein" not in t}
    stay = {i: t for t, i in {t: i for i, t in sorted(stay.items())}.items()}
    long = {i: t for i, t in stay.items() if len(t) > 200_000}
    want = {r[1] for r in brute([(i, t) for i, t in stay.items() if i not in long])} | set(long)
    assert len(long) == 1 and len(want) == 1802
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == want
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, got in pieces.items():
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at and r.offset + r.length <= 1024
            at += r.length
        assert {r.doc_tokens for r in got} == {at}
        # and the end of the text
        assert i in long or at == len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1


def test_stages_on_edge_rows(spark, edge, nothing, tmp_path):
    for kind, frame in (("edge", edge), ("nothing", nothing)):
        frame.write.parquet(str(tmp_path / kind))
        docs = spark.read.parquet(str(tmp_path / kind))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            out.write.parquet(str(tmp_path / f"{kind}-{name}"))
            assert name == "packing" or spark.read.parquet(str(tmp_path / f"{kind}-{name}")).columns == edge.columns


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry
    assert "pipeline" in entry.queries() and "op1_packing" in entry.queries()
    monkeypatch.setattr(entry, "_has", lambda name: False)
    assert not any(re.match(r"op\d|pipeline", k) for k in [*entry.queries(), *entry.oracle_sql()])
    assert os.path.exists(corpus_pipeline.__file__)
