"""Value counts with a rank index: quantiles by refinement, moments, fences, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ranks
from cohortlens.operators.describe import box_stats, boxed, describe, density_histogram, iqr_bounds
from cohortlens.operators.ranks import Distribution

PROBS = {"a": 0.0, "b": .01, "c": .25, "d": .5, "e": .9, "f": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(11)
    parts = {"hot": np.concatenate([rng.lognormal(3, 2, 9000), np.full(3000, 12.5)]),
             "near": 1e12 + rng.normal(0, 3, 2000).round(2), "signs": rng.normal(0, 1e-4, 1500),
             "wide": np.concatenate([rng.uniform(-1e300, 1e300, 300), [np.inf, -np.inf, 0.0, 5e-324]]),
             "one": np.array([7.0]), None: rng.integers(0, 5, 900).astype(float)}
    rows = [(g, float(v)) for g, vs in parts.items() for v in vs] + [("none", None), ("hot", None)]
    return parts, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("small, fanout, broadcast_rows", [(4096, 1024, 10_000), (3, 2, 10_000), (5, 7, 0)])
def test_refined_ranks_equal_numpy(values, monkeypatch, small, fanout, broadcast_rows):
    """Also where cells are refined over and over, and with replicated instead of broadcast tables."""
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(ranks, "FANOUT", fanout)
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", broadcast_rows)
    parts, df = values
    if fanout == 2:
        df = df.where("g = 'near' OR g IS NULL")  # a bit a round
    got = {r["g"]: r.asDict() for r in Distribution.of(df, "v", ["g"]).quantiles(PROBS, "disc", total="n").collect()}
    assert set(got) == ({"near", None} if fanout == 2 else set(parts))
    for g, r in got.items():
        vs = np.sort(parts[g])
        assert r["n"] == len(vs)
        for name, p in PROBS.items():
            assert r[name] == vs[max(1, int(np.ceil(p * len(vs)))) - 1], (g, name)


def test_interpolated_ranks_equal_pandas(values):
    parts, df = values
    for r in Distribution.of(df.where("g != 'wide' OR g IS NULL"), "v", ["g"]).quantiles(PROBS).collect():
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(pd.Series(parts[r["g"]]).quantile(p), rel=1e-14), (r["g"], name)


def test_many_distinct_values_in_one_group(spark):
    """The work of a task is bounded by cells, not by the group's distinct values."""
    n = 2_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), (1e9 + F.col("id") / 7.0).alias("v"))
    dist = Distribution.of(df, "v", ["g"])
    cells = dist.index().agg(F.count(F.lit(1)).alias("cells"), F.max("d").alias("d")).first()
    assert cells["cells"] < 100 and cells["d"] > ranks.SMALL  # refinement is needed
    r = dist.quantiles([.25, .5], "disc").first()
    assert (r["p25"], r["p50"]) == (1e9 + (n // 4 - 1) / 7.0, 1e9 + (n // 2 - 1) / 7.0)


def test_moments(values):
    parts, df = values
    df = df.where("g != 'wide' OR g IS NULL")
    got = {r["g"]: r for r in Distribution.of(df, "v", ["g"]).moments().collect()}
    for g, vs in parts.items():
        if g == "wide":
            continue
        r, s = got[g], pd.Series(vs)
        assert r["count"] == len(vs) and r["min"] == s.min() and r["max"] == s.max()
        assert r["mean"] == pytest.approx(s.mean(), rel=1e-7, abs=1e-6)
        if len(vs) > 1:  # also for values near 10^12 that differ by little
            assert r["std"] == pytest.approx(np.std(vs - vs.mean(), ddof=1), rel=1e-9)
    assert got["one"]["std"] is None
    assert (got["none"]["count"], got["none"]["mean"], got["none"]["std"]) == (0, None, None)


def test_moments_beyond_decimals(spark):
    rows = [("big", 1e30), ("big", 3e30), ("inf", 1.0), ("inf", float("inf")), ("nan", float("nan")), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in describe(df, "v", ["g"]).collect()}
    assert (got["big"]["mean"], got["big"]["p50"]) == (2e30, 2e30) and got["big"]["std"] == pytest.approx(2 ** .5 * 1e30)
    assert got["inf"]["mean"] == float("inf") and np.isnan(got["nan"]["mean"])
    assert sum(r["count"] for r in density_histogram(df.where("g = 'big'"), "v", ["g"], bins=3).collect()) == 2


def test_nothing_at_all(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert Distribution.of(empty, "v", ["g"]).moments().count() == 0
    assert Distribution.of(empty, "v", ["g"]).quantiles([.5]).count() == 0
    r = describe(empty, "v").first()
    assert (r["count"], r["mean"], r["p50"]) == (0, None, None)
    assert Distribution.of(empty, "v").quantiles([.5]).first()["p50"] is None


def test_integers_and_decimals_beyond_doubles(spark):
    df = spark.createDataFrame([(2 ** 60 + i,) for i in range(50)], "v long")
    r = Distribution.of(df, "v").quantiles([.5], "disc").first()
    assert r["p50"] == float(2 ** 60)


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_fences_boxes_and_ecdf(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(5)
    parts = {"a": rng.lognormal(0, 1, 4000).round(3), "b": rng.normal(0, 1, 900).round(3), "c": np.array([1.0, 1.0, 50.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in parts.items() for v in vs] + [("a", None)], "g string, v double")
    fences = {r["g"]: r for r in iqr_bounds(df, "v", 1.5, ["g"]).collect()}
    boxes = {r["g"]: r for r in box_stats(df, "v", ["g"]).collect()}
    for g, vs in parts.items():
        q1, med, q3 = np.quantile(vs, [.25, .5, .75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        f, b = fences[g], boxes[g]
        assert f["upper_percentile"] == pytest.approx(100 * (vs <= hi).mean(), abs=1e-4)
        assert [f["q1"], f["q3"], f["lower"], f["upper"]] == pytest.approx([q1, q3, lo, hi], abs=1e-4)
        assert [b["whisker_low"], b["whisker_high"]] == [vs[vs >= lo].min(), vs[vs <= hi].max()]
        assert b["fliers"] == ((vs < lo) | (vs > hi)).sum() and b["median"] == pytest.approx(med, abs=1e-4)



def test_input_is_read_once(spark):
    """Quartiles, moments and fences all come from the written counts."""
    ran = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        ran.add(1)
        return float(x)

    df = spark.range(500).select(seen(F.col("id")).alias("v"))
    dist = Distribution.of(df, "v")
    assert ran.value == 500
    describe_row = boxed(dist).first()
    assert describe_row["median"] == 249.5 and dist.moments().first()["count"] == 500 and ran.value == 500


def test_histogram_with_two_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
    df = spark.range(4000).selectExpr("IF(id % 2 = 0, 'x', 'y') AS g", "CAST(id % 97 AS DOUBLE) AS v")
    out = density_histogram(df, "v", ["g"], bins=7)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in line and "salt" in line for line in plan.splitlines())
    for g, rest in (("x", 0), ("y", 1)):
        vs = np.array([i % 97 for i in range(rest, 4000, 2)], float)
        got = [r["count"] for r in out.where(F.col("g") == g).orderBy("bin").collect()]
        assert got == np.histogram(vs, 7)[0].tolist()
