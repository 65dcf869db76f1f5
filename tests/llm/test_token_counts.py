import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import token_counts
from cohortlens.llm.token_counts import ChunkMap

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH)


def test_counts_equal_the_library(spark, edge, small_docs, library):
    for frame in (edge, small_docs):
        got = sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame, PATH).collect())
        texts = [r.text or "" for r in frame.select("text").collect()]
        assert got == sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)


def test_chunk_size_does_not_matter(counter, library):
    texts = ["'s's ''s don't l'été  a\n\nb", "x" * 500 + " " + "yz" * 200, "<|startoftext|>a b<|endoftext|>", "ΑΣ ΣΑΣ. Ω",
             "12 345!?! ..'ll", " lead and trail ", "ab́c é"]
    for t in texts:
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert [counter.count(t, n) for n in (1, 2, 3, 7, 64, 1 << 16)] == [want] * 6


def test_maps_compose_associatively(counter):
    rng = random.Random(6)
    for _ in range(50):
        a, b, c = (counter.chunk_map("".join(rng.choice("ab' s") for _ in range(rng.randint(1, 6)))) for _ in range(3))
        assert counter.compose(counter.compose(a, b), c) == counter.compose(a, counter.compose(b, c))
    assert counter.scan([ChunkMap("x", 0, None)]) == ChunkMap("x", 0, None)


def test_states_may_be_dropped(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 20)
    c = token_counts.Counter(PATH)
    rng = random.Random(7)
    for _ in range(30):
        t = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(20))
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_empty_table(nothing):
    assert token_counts.count_tokens(nothing, PATH).collect() == []
