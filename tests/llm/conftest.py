import os
import random

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, keep string, score double, "
          "n_words int, ids string, verdict string, label long")


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows; the further columns have names the operators use inside."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Straße", "naïve", "été", "x1", "日本", "it's", "#tag", "!!"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + "." for _ in range(12)]
    texts = [None, "", " ", "\n\n", "a", "word", "one two three four", prose[0], prose[0], prose[0], *prose,
             "x" * 3000, " ".join(prose * 40), "same line\n" * 40, "<|endoftext|> mid <|endoftext|>", "\x00\x1c tab\t\r\n",
             "ΑΣ ΣΑΣ", "İI", "😀 👍🏽 é"]
    ids = list(range(len(texts)))
    ids[3] = None
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else "s", None, "d", None, 0.5, 1, "i", "v", 7)
            for k, (i, t) in enumerate(zip(ids, texts))]
    return rows + [rows[8], rows[8], rows[0]]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
