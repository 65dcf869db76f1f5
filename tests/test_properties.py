"""Structural properties of composite results (on the sf0.001 tables)."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cohortlens.plans import realty, startups
from cohortlens.sources import adapters as A
from cohortlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def q():
    return queries()


def test_trimmed_rows_are_a_subset(spark):
    t = Tables(spark, SF)
    flats = A.r_flats(t)
    trimmed = realty.trim_flats(flats)
    assert trimmed.exceptAll(flats).count() == 0
    assert 0 < trimmed.count() < flats.count()


def test_normalisation_loses_no_company_or_round(spark):
    cr = A.s_company_and_rounds(Tables(spark, SF))
    companies = startups.normalize_companies_rounds(cr)
    rounds = startups.split_rounds(cr)
    assert companies.count() == cr.select("company_ID").distinct().count()
    assert rounds.count() == cr.where(F.col("funding_round_id").isNotNull()) \
        .select("funding_round_id").distinct().count()
    total = companies.agg(F.sum("rounds_count")).first()[0]
    assert total == rounds.where(F.col("raised_amount").isNotNull()).count()


def test_overall_payer_row_equals_payer_share(spark, q):
    overall = q["payer_share"](spark, SF).first()
    by_race = {r["race"]: r for r in q["payer_share_by_race"](spark, SF).collect()}
    assert by_race["all"]["players"] == overall["players"]
    assert by_race["all"]["payers"] == overall["payers"]
    assert by_race["all"]["share"] == overall["share"]
    assert sum(r["players"] for k, r in by_race.items() if k != "all") == overall["players"]


def test_retention_rate_is_one_at_the_running_max(spark, q):
    rows = sorted(q["retention_daily"](spark, SF).collect(), key=lambda r: r["day_since_install"])
    assert rows and rows[0]["retention_rate"] == 1.0
    assert all(0 <= r["retention_rate"] <= 1.0 for r in rows)


def test_shares_sum_to_hundred(spark, q):
    for name, col in [("value_share", "pct"), ("candidate_companies__status", "pct")]:
        total = sum(r[col] for r in q[name](spark, SF).collect())
        assert total == pytest.approx(100.0, abs=0.2), name
    for r in q["attribute_balance"](spark, SF).groupBy("attr").agg(F.sum("pct_a").alias("a"),
                                                                     F.sum("pct_b").alias("b")).collect():
        assert r["a"] == pytest.approx(100.0, abs=1e-3) and r["b"] == pytest.approx(100.0, abs=1e-3)


def test_histogram_integrates_to_one(spark, q):
    for r in q["density_histogram"](spark, SF).groupBy("city").agg(
            F.sum(F.col("density") * (F.col("high") - F.col("low"))).alias("area")).collect():
        assert r["area"] == pytest.approx(1.0, abs=1e-3)


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["log_date", "cr"]
    assert df.count() >= 0
