import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encode_and_decode_equal_the_library(spark, edge, small_docs, library):
    for frame in (edge.select("doc_id", "text"), small_docs.select("doc_id", "text")):
        rows = sorted((r.text or "") for r in frame.collect())
        coded = bpe.decode(bpe.encode(frame, PATH), PATH).collect()
        want = {t: library.encode(t, add_special_tokens=False).ids for t in rows}
        got = sorted((r.decoded, tuple(ids_of(r.ids)), r.n_tokens) for r in coded)
        assert got == sorted((t, tuple(want[t]), len(want[t])) for t in rows)
        assert all(library.decode(want[t], skip_special_tokens=False) == t for t in set(rows))


def test_long_words_and_short_ones_agree():
    b = bpe.RankArrayBPE(PATH)
    rng = random.Random(3)
    words = ["".join(rng.choice("abeéinorst") for _ in range(n)) for n in (1, 2, 5, 20, 40, 60) for _ in range(20)]
    assert b.encode_words(words) == [b._long_word(w.encode()) for w in words]


def test_long_word_equals_the_library(library):
    b = bpe.RankArrayBPE(PATH)
    for t in ["ab" * 2000, "x" * 5000, "!?" * 500, "é" * 700]:
        assert ids_of(b.encode_batch([t])[0]) == library.encode(t, add_special_tokens=False).ids


def test_decode_of_broken_bytes(library):
    b = bpe.RankArrayBPE(PATH)
    whole = ids_of(b.encode_batch(["日本😀é"])[0])
    for cut in range(len(whole)):
        assert b.decode(np.array(whole[cut:], "<u4").tobytes()) == library.decode(whole[cut:], skip_special_tokens=False)


def test_empty_tables(nothing):
    assert bpe.decode(bpe.encode(nothing, PATH), PATH).collect() == []
    assert packing.pack(nothing, PATH).collect() == []


def test_best_cuts_against_all_choices():
    rng = random.Random(4)
    for _ in range(60):
        gaps = [rng.randint(1, 6) for _ in range(rng.randint(1, 9))]
        bounds = np.cumsum([0, *gaps])
        pen = np.array([0, *[rng.choice([0, 1, 3]) for _ in gaps[:-1]], 0])
        cost = lambda cuts: sum(8 - (b - a) for a, b in itertools.pairwise(cuts)) + sum(
            pen[list(bounds).index(c)] for c in cuts[1:])
        inner = list(bounds[1:-1])
        best = min(cost([0, *c, bounds[-1]]) for n in range(len(inner) + 1) for c in itertools.combinations(inner, n)
                   if all(b - a <= 8 for a, b in itertools.pairwise([0, *c, bounds[-1]])))
        assert cost(packing.best_cuts(bounds, pen, 8).tolist()) == best


def check_pieces(pieces, texts, library, most):
    """texts: id -> text, ids unique."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids = library.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        ps.sort(key=lambda p: p.start)
        at = 0
        for p in ps:
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert ids_of(p.ids) == ids[at:at + p.length]
            at += p.length
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= most


def test_pieces_cover_every_id_once(spark, small_docs, library):
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    docs = small_docs.repartition(3)
    for kw in ({}, {"block_tokens": 3000}, {"max_tokens": 64, "grid": 8}):
        pieces = packing.pack(docs, PATH, **kw).collect()
        check_pieces(pieces, texts, library, kw.get("max_tokens", 1024))
    packed = packing.pack(small_docs.coalesce(1), PATH).collect()
    full, used = len({p.sequence_id for p in packed}) * 1024, sum(p.length for p in packed)
    assert used / full > 0.98


def test_packing_edge_rows_and_crc(spark, edge, library):
    rows = packing.pack(edge, PATH).collect()
    want = sorted(tuple(library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in edge.collect())
    got, open_doc = [], []
    for p in sorted(rows, key=lambda p: (p.sequence_id, p.offset)):
        open_doc += ids_of(p.ids)
        if len(open_doc) == p.doc_tokens:
            got.append(tuple(open_doc))
            open_doc = []
    assert sorted(got) == want and not open_doc
    from pyspark.sql import functions as F
    one = packing.pack(edge, PATH).select("ids", F.crc32("ids").alias("c")).first()
    assert one.c == zlib.crc32(one.ids)


def test_order_by_keeps_the_given_order(small_docs):
    rows = packing.pack(small_docs.repartition(4), PATH, order_by="doc_id").collect()
    rows.sort(key=lambda p: (p.sequence_id, p.offset))
    ids = [p.doc_id for p in rows]
    assert ids == sorted(ids)
