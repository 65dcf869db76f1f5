"""Closed-form statistics against published / recomputed golden values."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.common import floor_days, round_half_even, round_half_up, safe_div
from cohortlens.functions.stats import norm_cdf, t_sf
from cohortlens.operators import hypothesis as H


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("z", [-8.0, -3.1, -1.0, -0.2, 0.0, 0.5, 1.959964, 2.6116, 6.0, 7.5])
def test_norm_cdf_matches_stdlib(spark, z):
    assert _one(spark, norm_cdf(F.lit(z))) == pytest.approx(NormalDist().cdf(z), abs=1e-13)


def _t_tail_reference(t, nu, n=200000):
    # independent check: midpoint rule on the t density with lgamma normalisation
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    hi = 2000.0
    h = (hi - t) / n
    s = sum(c * (1 + ((t + (i + .5) * h) ** 2) / nu) ** (-(nu + 1) / 2) for i in range(n)) * h
    return s


@pytest.mark.parametrize("t,nu", [(2.228139, 10.0), (1.0, 3.0), (0.4028, 8538.0), (3.5, 37.5)])
def test_t_sf(spark, t, nu):
    got = _one(spark, t_sf(F.lit(t), F.lit(nu)))
    if nu > 1000:
        assert got == pytest.approx(1 - NormalDist().cdf(t), abs=2e-4)
    else:
        assert got == pytest.approx(_t_tail_reference(t, nu), abs=2e-5)


def test_t_sf_known_quantile(spark):
    # 97.5th percentile of t(10) is 2.228139 -> upper tail 0.025
    assert _one(spark, t_sf(F.lit(2.228139), F.lit(10.0))) == pytest.approx(0.025, abs=1e-6)


def test_ztest_published_books_result(spark):
    # 1782 buyers of 5011 (B) vs 1638 of 4952 (A): published one-sided p = 0.0045.
    # Pooled z by hand: (0.355618 - 0.330775) / 0.0095138 = 2.6112.
    counts = spark.createDataFrame([(1782, 5011, 1638, 4952)], "s1 long, n1 long, s2 long, n2 long")
    r = H.proportions_ztest(counts).first()
    assert r["z"] == pytest.approx(2.6112, abs=1e-3)
    assert round(r["p_value"], 4) == 0.0045
    assert r["significant"] is True


def test_newcombe_interval_from_published_rates(spark):
    # good-session rates 30.77 % of 49,551 (A) and 31.83 % of 50,454 (B)
    sa, sb = round(0.3077 * 49551), round(0.3183 * 50454)
    counts = spark.createDataFrame([(sb, 50454, sa, 49551)], "s1 long, n1 long, s2 long, n2 long")
    r = H.lift_confint(counts).first()
    assert round(r["ci_low"] * 100, 2) == pytest.approx(0.49, abs=0.011)
    assert round(r["ci_high"] * 100, 2) == pytest.approx(1.64, abs=0.011)


def test_sample_size_formula(spark):
    b = spark.createDataFrame([("ab", 0.30)], "segment string, baseline double")
    assert H.required_sample_size(b, mde=0.03, relative=True).first()["n_per_group"] == 41040
    assert H.required_sample_size(b, mde=0.03, relative=False, rounding="round").first()["n_per_group"] == 3762


def test_pooled_and_welch_ttest(spark):
    a = [5.0, 6.0, 7.0, 8.0, 9.0]
    b = [1.0, 2.0, 3.0, 4.0, 9.0, 12.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    va = sum((x - ma) ** 2 for x in a) / (len(a) - 1)
    vb = sum((x - mb) ** 2 for x in b) / (len(b) - 1)
    sp2 = ((len(a) - 1) * va + (len(b) - 1) * vb) / (len(a) + len(b) - 2)
    t_pooled = (ma - mb) / math.sqrt(sp2 * (1 / len(a) + 1 / len(b)))
    se2 = va / len(a) + vb / len(b)
    t_welch = (ma - mb) / math.sqrt(se2)
    df_welch = se2 ** 2 / ((va / len(a)) ** 2 / (len(a) - 1) + (vb / len(b)) ** 2 / (len(b) - 1))

    pooled = H.ttest_ind(df, "g", "v", "a", "b").first()
    assert pooled["t"] == pytest.approx(t_pooled, abs=1e-6)
    assert pooled["df"] == 9
    assert pooled["p_value"] == pytest.approx(2 * _t_tail_reference(abs(t_pooled), 9.0), abs=2e-5)
    welch = H.ttest_ind(df, "g", "v", "a", "b", equal_var=False, alternative="greater").first()
    assert welch["t"] == pytest.approx(t_welch, abs=1e-6)
    assert welch["df"] == pytest.approx(df_welch, abs=1e-6)
    assert welch["p_value"] == pytest.approx(_t_tail_reference(t_welch, df_welch), abs=2e-5)


def test_safe_div_and_rounding(spark):
    r = spark.range(1).select(
        safe_div(F.lit(1), F.lit(0)).alias("z"),
        round_half_up(F.lit(2.675), 2).alias("u"),
        round_half_even(F.lit(0.125), 2).alias("e"),
        round_half_up(F.lit(344451.05874999997), 4).alias("below"),
        round_half_up(F.lit(344451.05875), 4).alias("half")).first()
    assert r["z"] is None
    assert r["u"] == 2.68
    assert r["e"] == 0.12
    # A value is rounded as it stands; sums are exact, so that none ends up
    # just below a half by the order of its terms.
    assert r["below"] == 344451.0587
    assert r["half"] == 344451.0588


def test_floor_days_negative(spark):
    df = spark.createDataFrame([("2024-01-02 10:00:00", "2024-01-03 09:00:00"),
                                ("2024-01-05 10:00:00", "2024-01-03 11:00:00")], "a string, b string")
    got = [r[0] for r in df.select(floor_days(F.to_timestamp("a"), F.to_timestamp("b"))).collect()]
    assert got == [-1, 1]


def test_degenerate_inputs_give_nulls_not_errors(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    r = H.ttest_ind(df, "g", "v", "a", "b").first()          # zero variance in both arms
    assert r["t"] is None
    counts = spark.createDataFrame([(0, 0, 5, 10)], "s1 long, n1 long, s2 long, n2 long")
    assert H.proportions_ztest(counts).first()["z"] is None  # empty arm
    assert H.lift_confint(counts).first()["ci_low"] is None
    b = spark.createDataFrame([("zero", 0.0)], "segment string, baseline double")
    assert H.required_sample_size(b, mde=0.03, relative=True).first()["n_per_group"] is None


@pytest.mark.parametrize("value,dp,up,even", [
    (1234567890123.45, 2, 1234567890123.45, 1234567890123.45), (98765432109.87, 2, 98765432109.87, 98765432109.87),
    (0.125, 2, 0.13, 0.12), (2.5, 0, 3.0, 2.0), (-2.5, 0, -3.0, -2.0), (3e26, 2, 3e26, 3e26), (277502.40875, 4, 277502.4088, 277502.4088)])
def test_rounding_of_large_values_and_ties(spark, value, dp, up, even):
    assert _one(spark, round_half_up(F.lit(value), dp)) == up
    assert _one(spark, round_half_even(F.lit(value), dp)) == even


def test_large_sums_keep_their_cents(spark):
    from cohortlens.functions.common import exact_avg, exact_sum
    x = spark.range(200_000).select((F.lit(87_654_321.05) + F.col("id") % 100 / 100).alias("x"))
    row = x.repartition(7).agg(exact_sum("x").alias("s"), exact_avg("x").alias("m")).first()
    want = sum(8_765_432_105 + i % 100 for i in range(200_000))
    assert int(row.s * 100) == want and want > 10**15
    assert _one(spark, round_half_up(F.lit(row.s), 2)) == want / 100


def test_share_of_categories_rounds_once_to_even(spark):
    from cohortlens.plans.places import category_share
    rows = [("a",)] + [("b",)] * 799
    got = {r["value"]: r["pct"] for r in category_share(spark.createDataFrame(rows, "category string")).collect()}
    assert got == {"a": 0.12, "b": 99.88}
