"""Distributed exact quantiles against Spark's built-in aggregate and pandas."""

import numpy as np
import pandas as pd
import pytest

from cohortlens.operators.quantiles import column_quantiles, quantiles


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 6000
    g = rng.choice(["hot", "b", "c"], size=n, p=[.8, .15, .05])
    v = np.round(rng.lognormal(2, 1, size=n), 1)
    v[rng.random(n) < 0.35] = 3.0          # one value holds a third of the rows
    v[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("kind", ["cont", "disc"])
def test_exact_matches_builtin(data, kind):
    _, df = data
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    a = quantiles(df, "v", probs, ["g"], kind=kind).orderBy("g").toPandas()
    b = quantiles(df, "v", probs, ["g"], kind=kind, method="builtin").orderBy("g").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_exact_matches_pandas_global(data):
    pdf, df = data
    got = quantiles(df, "v", {"q": 0.37}, kind="cont").first()["q"]
    assert got == pytest.approx(pdf["v"].dropna().quantile(0.37))


def test_all_null_group_is_absent(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("n", None)], "g string, v double")
    out = quantiles(df, "v", [0.5], ["g"]).collect()
    assert [(r["g"], r["p50"]) for r in out] == [("a", 1.5)]


def test_null_group_key_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0)], "g string, v double")
    out = {r["g"]: r["p50"] for r in quantiles(df, "v", [0.5], ["g"], kind="disc").collect()}
    assert out == {None: 1.0, "x": 5.0}


def test_column_quantiles_one_pass(data):
    pdf, df = data
    df2 = df.withColumn("w", df["v"] * 2)
    r = column_quantiles(df2, ["v", "w"], {"med": .5}).first()
    assert r["w_med"] == pytest.approx(2 * r["v_med"])
    assert r["v_med"] == pytest.approx(pdf["v"].dropna().median())


def test_partition_count_invariance(data):
    _, df = data
    a = quantiles(df.repartition(1), "v", [0.1, 0.9], ["g"]).orderBy("g").toPandas()
    b = quantiles(df.repartition(7), "v", [0.1, 0.9], ["g"]).orderBy("g").toPandas()
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("kind", ["cont", "disc"])
def test_small_domain_matches_builtin(spark, kind):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(str(g), int(v)) for g, v in zip(rng.choice(list("xyz"), 3000, p=[.7, .2, .1]),
                                              rng.integers(0, 12, 3000))]
    df = spark.createDataFrame(rows, "g string, v int")
    a = quantiles(df, "v", [0.1, 0.5, 0.9], ["g"], kind=kind).orderBy("g").toPandas()
    b = quantiles(df, "v", [0.1, 0.5, 0.9], ["g"], kind=kind, method="builtin").orderBy("g").toPandas()
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("kind", ["cont", "disc"])
def test_quantiles_from_counts_equals_raw(spark, kind):
    from pyspark.sql import functions as F
    from cohortlens.operators.quantiles import quantiles_from_counts
    rows = [("a", v) for v in (1, 1, 2, 5, 5, 5, 9)] + [("b", v) for v in (3, 4)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    a = quantiles_from_counts(counts, "v", "n", [0.25, 0.5, 0.9], ["g"], kind=kind).orderBy("g").toPandas()
    b = quantiles(df, "v", [0.25, 0.5, 0.9], ["g"], kind=kind, method="builtin").orderBy("g").toPandas()
    pd.testing.assert_frame_equal(a, b)
