import random
import tracemalloc

import pyarrow as pa

from cohortlens.llm.common import text_slices


def expected(texts, max_chars, max_rows):
    out = []
    for t in texts:
        if not out or len(out[-1]) >= max_rows or sum(map(len, out[-1])) + len(t) > max_chars:
            out.append([])
        out[-1].append(t)
    return out


def test_slices_are_bounded_and_whole():
    rng = random.Random(3)
    for max_chars, max_rows in ((40, 5), (1, 3), (10_000, 7), (10_000, 1_000)):
        texts = [rng.choice([None, "", "é", "日本😀", "x" * 50, "word " * rng.randint(0, 6)]) for _ in range(200)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts, pa.string())], ["id", "text"])
        for given in (batch, batch.slice(17, 90), batch.slice(0, 0)):
            got = list(text_slices([given], "text", max_chars, max_rows))
            whole = [t or "" for t in given.column(1).to_pylist()]
            assert [texts for _, texts in got] == expected(whole, max_chars, max_rows)
            assert [i for part, _ in got for i in part.column(0).to_pylist()] == given.column(0).to_pylist()


def test_only_a_slice_is_in_python_strings():
    column = pa.array(["%04d" % i + "x" * 1_000 for i in range(5_000)])
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    tracemalloc.start()
    try:
        rows = sum(len(texts) for _, texts in text_slices([batch], "text", max_chars=20_000))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 5_000 and peak < 1_000_000  # all texts: over 5 MB
