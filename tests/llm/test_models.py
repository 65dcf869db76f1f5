import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import catalog, langid, toxicity
from cohortlens.llm.common import crc_remainder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.01"


# --- language identification ----------------------------------------------

def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, min(len(word), langid.MAX_PIECE) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_and_expected_counts_by_listing_segmentations():
    v = langid.vocabulary(PIECES)
    at = {p: i for i, p in enumerate(v.pieces)}
    rng = np.random.default_rng(1)
    p = rng.random((len(v.pieces), 2))
    p /= p.sum(0)
    model = langid.Model(PIECES, ["a", "b"], p)
    words = ["▁the", "▁été", "▁qui", "▁日本x", "▁straße"]
    prob = lambda seg, k: math.prod(p[at[x], k] if x in at else langid.UNKNOWN for x in seg)
    scores = model.word_scores(words)
    for w, got in zip(words, scores):
        for k in (0, 1):
            assert got[k] == pytest.approx(math.log(sum(prob(s, k) for s in segmentations(w, at))), rel=1e-9)
    w = "▁the"
    counts = langid.expected_counts(v.lattice([w]), len(w), langid._with_unknown(p), np.array([[3.0, 0.0]]), len(v.pieces))
    total = sum(prob(s, 0) for s in segmentations(w, at))
    for x in {x for s in segmentations(w, at) for x in s if x in at}:
        assert counts[at[x], 0] == pytest.approx(sum(3 * s.count(x) * prob(s, 0) for s in segmentations(w, at)) / total)
    assert counts[:, 1].sum() == 0


def test_lookup_finds_every_piece_and_nothing_else():
    v = langid.vocabulary(PIECES)
    for n in range(1, langid.MAX_PIECE + 1):
        same = [p for p in v.pieces if len(p) == n]
        ids = [x[2] for x in v.lattice(same) if x[:2] == (0, n)][0]
        assert [v.pieces[i] for i in ids] == same
    whole = [ids for start, end, ids in v.lattice(["日月ж", "жжж"]) if (start, end) == (0, 3)][0]
    assert set(whole) == {len(v.pieces)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = catalog.op6_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_edges(spark, edge, nothing):
    model = langid.train(edge, F.lit(True), PIECES)
    assert model.languages == ["en"]
    text = edge.select("doc_id", "text")
    for r, t in zip(langid.predict(text, model).collect(), text.collect()):
        letter = any(c.isalpha() for c in t.text or "")
        assert (r.lang_pred, r.score) == (("en", 1.0) if letter else ("und", 0.0))
    none = langid.train(nothing, F.lit(True), PIECES)
    assert {r.lang_pred for r in langid.predict(edge, none).collect()} == {"und"}
    assert langid.predict(nothing, model).collect() == []


def test_words_over_the_limit_are_scored_in_parts():
    long = "ab" * 40
    assert "".join(langid.split_words(long)) == "▁" + long
    assert max(map(len, langid.split_words(long))) <= langid.MAX_WORD + 1


# --- toxicity ---------------------------------------------------------------

def test_noisy_or_by_brute_force():
    model = toxicity.Model(-2.0, {"bad": 3.0, "^wor": 1.5, "worst": 0.5})
    text = "A bad day. Worst of all! bad bad\nFine."
    z = [-2 + 3, -2 + 1.5 + 0.5, -2 + 3, -2]
    p = [1 / (1 + math.exp(-x)) for x in z]
    score, sentences = model.score(text)
    leak = math.log1p(math.exp(-2))
    own = [math.log1p(math.exp(x)) for x in z]
    assert score == pytest.approx(1 - math.exp(-leak - sum((x - leak) ** 2 / x for x in own if x > leak)))
    # far over the bias a sentence has the noisy-or's own probability
    assert toxicity.Model(-20.0, {"bad": 21.0}).score("bad")[0] == pytest.approx(1 / (1 + math.exp(-1)), abs=1e-6)
    assert [s[2] for s in sentences] == pytest.approx(p)
    assert [text[a:b].strip() for a, b, _ in sentences] == ["A bad day.", "Worst of all!", "bad bad", "Fine."]


def test_gradient_of_the_trained_likelihood():
    """The fit follows the loss of the very score that is given out."""
    rng = np.random.default_rng(2)
    document = np.sort(rng.integers(0, 12, 40))
    words, sentence = rng.integers(0, 6, 90), rng.integers(0, 40, 90)
    toxic, share = (np.arange(12) % 3 == 0).astype(float), np.full(12, 1 / 12)
    theta = np.append(rng.normal(0.5, 1, 6), -3.0)
    loss, grad = toxicity.loss_and_gradient(theta, words, sentence, document, share, toxic)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        high, low = (toxicity.loss_and_gradient(theta + s, words, sentence, document, share, toxic)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((high - low) / 2e-6, rel=1e-4, abs=1e-8)
    model = toxicity.Model(-3.0, {f"w{i}": theta[i] for i in range(6)})
    texts = [". ".join(" ".join({f"w{w}" for w in words[sentence == s]}) or "none" for s in np.flatnonzero(document == d))
             for d in range(12)]
    counts = np.unique(np.stack([sentence, words]), axis=1)  # a word counts once in a sentence
    once, _ = toxicity.loss_and_gradient(theta, counts[1], counts[0], document, share, toxic)
    scores = np.array([model.score(t)[0] for t in texts])
    assert once == pytest.approx(-(share * np.where(toxic > 0, np.log(scores), np.log1p(-scores))).sum())


def test_score_is_continuous_in_the_weights():
    text = "Some plain words. More of them here.\n" * 250
    scores = [toxicity.Model(-5.0, {"plain": w}).score(text)[0] for w in (-1.0, -1e-6, 0.0, 1e-6, 1e-3, 1e-2)]
    assert scores[0] == scores[1] == scores[2] and scores[3] == pytest.approx(scores[2], abs=1e-9)
    assert scores[4] == pytest.approx(scores[2], abs=1e-5) and scores[5] == pytest.approx(scores[2], abs=1e-3)


@pytest.mark.parametrize("size", [1_000_000, 5_000_000, 20_000_000])
def test_long_clean_texts_stay_below_the_threshold(size, fitted):
    model, clean = fitted
    text = "\n".join(clean)
    text = (text + "\n") * (size // len(text) + 1)
    assert model.score(text)[0] < 0.3


@pytest.fixture(scope="module")
def fitted():
    """A model of three quarters of the labelled documents, and the clean ones of the last quarter."""
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist() if r["toxic"] is not None}
    rows = [(r["doc_id"], r["text"] or "", labels[r["doc_id"]]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()
            if r["doc_id"] in labels]
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = toxicity.fit([t for _, t, _ in seen], np.array([float(y) for *_, y in seen]), np.ones(len(seen)))
    clean = [t for i, t, y in rows if not y and zlib.crc32(str(i).encode()) % 4 == 2]
    passed = [t for t in clean if model.score(t)[0] < 0.3]
    assert len(passed) > 0.95 * len(clean)
    return model, passed


def test_the_text_of_a_repeated_id_is_fixed(spark):
    rows = [(i, f"text {k} of {i} is " + ("vilein." if i % 2 else "fine.") + " x" * k) for i in range(40) for k in range(3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [toxicity.train(docs.repartition(n), labels, F.lit(True)) for n in (1, 5)]
    assert models[0] == models[1] and models[0].weights


def test_learns_from_document_labels_and_locates_the_sentence():
    rng = random.Random(11)
    words = ["w%d" % i for i in range(60)]
    texts, labels, guilty = [], [], []
    for i in range(400):
        lines = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(rng.randint(2, 8))]
        if i % 4 == 0:
            k = rng.randrange(len(lines))
            lines[k] = lines[k][:-1] + " vilein" + rng.choice(["", "s", "ly"]) + "."
            guilty.append((i, k))
        texts.append(" ".join(lines))
        labels.append(float(i % 4 == 0))
    model = toxicity.fit(texts[100:], np.array(labels[100:]), np.ones(300))
    scores = [model.score(t) for t in texts[:100]]
    assert all((s >= 0.3) == (y == 1) for (s, _), y in zip(scores, labels))
    for i, k in guilty:
        if i < 100:
            assert max(range(len(scores[i][1])), key=lambda j: scores[i][1][j][2]) == k


def test_length_alone_makes_no_document_toxic():
    model = toxicity.Model(-9.0, {"vilein": 10.0, "pale": -2.0})
    clean = "A quiet day. Pale light fell on it.\n" * 10_000
    assert len(toxicity.sentence_words(clean)) == 20_000
    assert model.score("")[0] == model.score(clean)[0] < 0.06  # length adds nothing
    score, sentences = model.score(clean + "You vilein.\n" + clean)
    assert score > 0.3 and sum(p > 0.3 for _, _, p in sentences) == 1


def test_long_labelled_texts_are_in_the_sample(spark):
    line = "some plain words stand here. "
    rows = [(i, line * 8_000 + ("vilein thing." if i % 2 else "other thing.")) for i in range(24)]
    docs = spark.createDataFrame(rows + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)] + [(99, 0)], "doc_id long, toxic int")
    assert len(rows[0][1]) > 200_000
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.weights
    small = toxicity.train(docs, labels, F.lit(True), total_chars=400_000)
    assert not small.weights
    assert toxicity.within([(1, 0, 60), (2, 0, 40), (3, 1, 5), (4, 0, 31), (5, 0, 30)], {0: 100, 1: 10}) == [2, 3, 5]


def test_toxicity_query(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    rows = catalog.op4_toxicity(spark, DATA).join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    pairs = list(itertools.product([r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]))
    assert sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) > 0.85


def test_toxicity_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(None, 1), (1, None), (9, 1), (9, 0), (10, 0), (999, 1)], "doc_id long, toxic int")
    rest = crc_remainder("doc_id", 4) != 2
    for docs, given in ((edge, labels), (nothing, labels), (edge, labels.limit(0))):
        model = toxicity.train(docs, given, rest)
        out = toxicity.score(docs, model)
        assert out.count() == docs.count()
        assert all(0 <= r.score <= 1 for r in out.collect())
    kept = toxicity.score(edge, toxicity.Model(-3.0, {}), score_col="__s", offending_col="__o")
    assert kept.columns[:-2] == edge.columns and {r.score for r in kept.collect()} == {0.5}
