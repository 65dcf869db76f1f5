"""Spelling variants: near words by all pairs, forms and roots by a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest

from cohortlens.llm import spelling as S
from cohortlens.llm.catalog import op13_spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows, misspell=None, min_count=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if misspell and h % misspell == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}


def plain_variants(words, ratio=5):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    others = {w: [x for n in (len(w) - 1, len(w), len(w) + 1) for x in by_length.get(n, ()) if near(w, x)] for w in words}
    form = {}
    for w, xs in others.items():
        if xs and words[best := min(xs, key=lambda x: (-words[x], x))] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(others[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_bound_covers_every_edit():
    """Of n grams at least n - B stand in each near word, in place; B is the word's own bound."""
    rng = random.Random(5)
    for _ in range(400):
        frequent = {"".join(rng.choice("abc^$") for _ in range(rng.randint(2, 5))): 9 for _ in range(rng.randint(0, 120))}
        word = "".join(rng.choice("abc") for _ in range(rng.randint(6, 14)))
        q, i = rng.randint(2, 6), rng.randrange(len(word))
        grams = S.decompose("^" + word + "$", q, frequent)
        for other, shift in ((word[:i] + word[i + 1:], -1), (word[:i] + "b" + word[i:], 1), (word[:i] + "c" + word[i + 1:], 0)):
            there = set(S.decompose("^" + other + "$", q, frequent))
            kept = sum((g, p) in there or (g, p + shift) in there for g, p in grams)
            assert kept >= len(grams) - S.affected(grams, q), (word, other, q)


def test_shared_keys_for_all_near_pairs():
    rng = random.Random(6)
    frequent = {"".join(rng.choice("ab^$") for _ in range(n)): rng.randint(5, 50) for n in (2, 2, 2, 3, 3, 3, 4, 4, 5)}
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 13)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + "z" + a[i:], a[:i] + "z" + a[i + 1:]])
        keys = []
        for w, longer in ((a, False), (b, len(b) > len(a))):
            c = len(a)
            listed = S.signature("^" + w + "$", S.level_of(c), frequent)
            keys.append({S.list_keys(c, l, g, p - d) for l, g, p in listed for d in ((0, 1) if longer else (0,)) if p >= d})
        assert keys[0] & keys[1], (a, b)


@pytest.mark.parametrize("frequent", [2, 50, 20_000])
def test_variants_against_all_pairs(spark, frequent):
    rng = random.Random(7)
    syllables = ["an", "er", "tion", "ß", "la", "ché", "o", "x"]
    words = {}
    for _ in range(700):
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(2, 6)))
        if len(w) >= 6:
            words[w] = rng.choice([5, 5, 6, 30, 31, 200, 1000])
    for w in list(words)[:200]:
        i = rng.randrange(len(w))
        v = rng.choice([w[:i] + w[i + 1:], w[:i] + "é" + w[i:], w[:i] + "a" + w[i + 1:]])
        if len(v) >= 6:
            words.setdefault(v, 5)
    assert rows_of(S.variants(frame(spark, words), frequent=frequent)) == plain_variants(words)


def test_chains_ties_and_long_words(spark):
    long = "ab" * 50_000
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125,
             "zzzzzz": 10, "zzzzzy": 50, "zzzzzx": 50, "einzeln": 7, long: 5, long[:70_000] + "c" + long[70_000:]: 50}
    got = rows_of(S.variants(frame(spark, words)))
    assert got == plain_variants({w: n for w, n in words.items() if len(w) < 1000}) | {
        (long, long[:70_000] + "c" + long[70_000:], long[:70_000] + "c" + long[70_000:], 5, 1, 50),
        (long[:70_000] + "c" + long[70_000:], None, long[:70_000] + "c" + long[70_000:], 50, 1, None)}
    assert ("aaaaaa", "aaaaab", "bbbbbb", 5, 1, 25) in got and ("zzzzzz", "zzzzzx", "zzzzzx", 10, 2, 50) in got


def test_word_counts_with_edges(spark, edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = {r.word: r.n for r in S.word_counts(edge, min_count=1, misspell=7).collect()}
    assert got == plain_counts(rows, 7, 1) and got
    assert S.variants(S.word_counts(nothing)).count() == 0
    text = "Überraß élan×÷ " * 120_000  # longer than the part that is read at once
    long = spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")
    assert {r.word: r.n for r in S.word_counts(long).collect()} == {"Überraß": 240_000, "élan×÷": 240_000}


def test_a_hot_list(spark):
    """A third of the words share their grams: lists are joined whole."""
    words = {f"gemeinsam{a}{b}": 5 + (i % 3) * 40 for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "klmnopqrst")}
    words |= {f"{a}{b}{c}xyzuvw": 9 for a in "abcde" for b in "fghij" for c in "klmno"}
    assert rows_of(S.variants(frame(spark, words), frequent=3)) == plain_variants(words)


def test_small_ratio_is_refused(spark):
    with pytest.raises(ValueError):
        S.variants(frame(spark, {"aaaaaa": 5}), ratio=1)


def test_query_against_the_plain_version(spark, small_docs):
    words = plain_counts([(r.doc_id, r.text) for r in small_docs.collect()], 199)
    assert rows_of(op13_spelling(spark, "/root/testdata/sf0.001")) == plain_variants(words)
