"""Real-estate listing analysis: outlier trimming, exposure segments,
seasonality, settlement market and rankings.

Inputs: ``r_flats`` (id, total_area, rooms, balcony, ceiling_height,
city_id, is_apartment), ``r_advertisement`` (id, first_day_exposition,
days_exposition, last_price) and ``r_city`` (city_id, city).  Flats and
adverts are 1:1 on ``id``; the city table is a small dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.common import exact_avg, exact_sum, round_half_up, safe_div
from cohortlens.operators.trim import trim_outliers
from cohortlens.session import written

# --- fixed values: the study's exposure buckets (inclusive day ranges);
# anything else, including still-active listings with a null duration,
# falls in the last label.
EXPOSURE_BUCKETS = ((1, 30, "month"), (31, 90, "quarter"), (91, 180, "half_year"))
EXPOSURE_OTHER = "over_half_year"


def trim_flats(flats: DataFrame) -> DataFrame:
    """The study's standard trimming: 99th percentile caps, ceiling height
    also floored at the 1st percentile; nulls pass except for total area.

    The flats are written once, with the columns that they have, for the limits
    and the filter.
    """
    return trim_outliers(
        written(flats, "flats"),
        upper={"total_area": .99, "rooms": .99, "balcony": .99, "ceiling_height": .99},
        lower={"ceiling_height": .01},
        null_ok=("rooms", "balcony", "ceiling_height"))


def _flat_ads(flats: DataFrame, ads: DataFrame) -> DataFrame:
    # Both sides are keyed by id (1:1); sort-merge/AQE picks the strategy.
    return trim_flats(flats).join(ads, "id")


def _region(city_col, capital: str, other: str = "province"):
    return F.when(city_col == capital, F.lit(capital)).otherwise(F.lit(other))


def _drop_years(df: DataFrame, partial_years: Sequence[int]) -> DataFrame:
    if not partial_years:
        return df
    return df.where(~F.year("first_day_exposition").isin(list(partial_years)))


def _pairs(value: str, count: str):
    """Sorted (value, count) pairs of a group, as an aggregate.

    A group has one for each distinct pair of room and balcony numbers, which
    are small integers.
    """
    return F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(
        F.col(value).alias("v"), F.col(count).alias("n")))))


def _half(pairs: str):
    """Rank of the discrete median."""
    return F.ceil(F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x["n"]) / 2)


def _median(pairs: str, half: str):
    none = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("v"))
    return F.aggregate(pairs, none, lambda a, x: F.struct(
        (a["c"] + x["n"]).alias("c"),
        F.when((a["c"] < F.col(half)) & (a["c"] + x["n"] >= F.col(half)), x["v"]).otherwise(a["v"]).alias("v")),
        lambda a: a["v"])


def exposure_segments(flats: DataFrame, ads: DataFrame, cities: DataFrame, capital: str,
                      partial_years: Sequence[int] = ()) -> DataFrame:
    """Region x exposure bucket x housing type: ads, price/m2, area, medians."""
    d = F.col("days_exposition")
    cat = F.lit(EXPOSURE_OTHER)
    for lo, hi, label in reversed(EXPOSURE_BUCKETS):
        cat = F.when(d.between(lo, hi), F.lit(label)).otherwise(cat)
    x = (_drop_years(_flat_ads(flats, ads), partial_years)
         .join(cities.select("city_id", "city"), "city_id")
         .select(_region(F.col("city"), capital).alias("region"), cat.alias("exposition_category"),
                 F.when(F.col("is_apartment") == 1, "apartments").otherwise("flat")
                  .alias("apartment_category"),
                 "total_area", "rooms", "balcony",
                 safe_div("last_price", "total_area").alias("price_per_sqm")))
    keys = ["region", "exposition_category", "apartment_category"]
    # One pass over the fact join: pre-aggregate to (segment, rooms, balcony)
    # with counts and sums.  rooms / balcony are small integer counts, so this
    # table is small; the averages and the exact medians both derive from it.
    pre = x.groupBy(*keys, "rooms", "balcony").agg(
        F.count(F.lit(1)).alias("n"), exact_sum("price_per_sqm").alias("s_pps"),
        F.count("price_per_sqm").alias("c_pps"), exact_sum("total_area").alias("s_ta"),
        F.count("total_area").alias("c_ta"))
    agg = pre.groupBy(*keys).agg(
        F.sum("n").alias("total_ads"), safe_div(F.sum("s_pps"), F.sum("c_pps")).alias("pps"),
        safe_div(F.sum("s_ta"), F.sum("c_ta")).alias("ta"),
        _pairs("rooms", "n").alias("r"), _pairs("balcony", "n").alias("b"))
    agg = agg.withColumns({"half_r": _half("r"), "half_b": _half("b")})
    return agg.select(*keys, F.col("total_ads").cast("long").alias("total_ads"),
                    round_half_up("pps", 0).alias("avg_price_per_sqm"),
                    round_half_up("ta", 2).alias("avg_total_area"),
                    _median("r", "half_r").alias("median_rooms"),
                    _median("b", "half_b").alias("median_balcony"))


def listing_seasonality(flats: DataFrame, ads: DataFrame,
                        partial_years: Sequence[int] = ()) -> DataFrame:
    """Published vs withdrawn listings by calendar month, with shares of all ads.

    One pass: every listing emits a ``published`` record (its first day) and,
    when withdrawn, a ``withdrawn`` record (first day + duration); a single
    conditional aggregate by month builds both sides.  As in the study, a
    month appears only if listings were published in it (left join from the
    published side), and shares divide by all listings.
    """
    x = _drop_years(_flat_ads(flats, ads), partial_years)
    last_day = F.when(F.col("days_exposition") > 0,
                      F.date_add("first_day_exposition", F.col("days_exposition")))
    recs = F.filter(F.array(
        F.struct(F.lit("p").alias("kind"), F.col("first_day_exposition").alias("day")),
        F.when(last_day.isNotNull(), F.struct(F.lit("w").alias("kind"), last_day.alias("day")))),
        lambda r: r.isNotNull())
    long = x.select(F.explode(recs).alias("r"), "total_area",
                    safe_div("last_price", "total_area").alias("pps")).select("r.kind", "r.day", "total_area", "pps")
    is_p, is_w = F.col("kind") == "p", F.col("kind") == "w"
    g = (long.groupBy(F.month("day").alias("month_num"), F.date_format("day", "MMMM").alias("month_name"))
         .agg(F.count(F.when(is_p, 1)).alias("total_published"),
              F.count(F.when(is_w, 1)).alias("w"),
              round_half_up(exact_avg(F.when(is_p, F.col("total_area"))), 2).alias("avg_area_published"),
              round_half_up(exact_avg(F.when(is_p, F.col("pps"))), 0).alias("price_per_sqm_published"),
              round_half_up(exact_avg(F.when(is_w, F.col("total_area"))), 2).alias("avg_area_withdrawn"),
              round_half_up(exact_avg(F.when(is_w, F.col("pps"))), 0).alias("price_per_sqm_withdrawn"))
         .where(F.col("total_published") > 0))
    # All listings = all published records: a sum over the (at most 12) month rows.
    total = F.sum("total_published").over(Window.partitionBy())
    wd = F.when(F.col("w") > 0, F.col("w"))
    return g.select("month_num", "month_name", "total_published", wd.alias("total_withdrawn"),
                    "avg_area_published", "price_per_sqm_published", "avg_area_withdrawn",
                    "price_per_sqm_withdrawn",
                    round_half_up(safe_div(F.col("total_published") * 100.0, total), 1).alias("percent_published"),
                    round_half_up(safe_div(wd * 100.0, total), 1).alias("percent_withdrawn"))


def settlement_market(flats: DataFrame, ads: DataFrame, cities: DataFrame, capital: str,
                      partial_years: Sequence[int] = (), min_ads: int = 50) -> DataFrame:
    """Settlements outside the capital with more than ``min_ads`` listings."""
    x = (_drop_years(_flat_ads(flats, ads), partial_years)
         .join(cities.select("city_id", "city"), "city_id")
         .where(F.col("city") != capital))
    g = x.groupBy("city").agg(
        F.count(F.lit(1)).alias("total_ads"),
        exact_avg(safe_div("last_price", "total_area")).alias("pps"),
        exact_avg("total_area").alias("ta"), F.avg("days_exposition").alias("dx"),
        F.sum(F.col("days_exposition").isNotNull().cast("int")).alias("off"))
    return (g.where(F.col("total_ads") > min_ads)
            .select("city", "total_ads", round_half_up("pps", 0).alias("avg_price_per_sqm"),
                    round_half_up("ta", 2).alias("avg_total_area"),
                    round_half_up("dx", 0).alias("avg_days_exposition"),
                    round_half_up(safe_div(F.col("off") * 100.0, "total_ads"), 1)
                    .alias("percent_removed")))


# criterion name -> (metric column, descending?)
RANKING_CRITERIA = (
    ("most_ads", "total_ads", True),
    ("most_removed", "percent_removed", True),
    ("highest_price_per_sqm", "avg_price_per_sqm", True),
    ("largest_area", "avg_total_area", True),
    ("shortest_exposure", "avg_days_exposition", False),
    ("longest_exposure", "avg_days_exposition", True),
)


def settlement_rankings(market: DataFrame, k: int = 5) -> DataFrame:
    """Top-``k`` settlements per criterion (ties broken by city name)."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("criterion"), F.col(col).cast("double").alias("value"),
                 (F.col(col).cast("double") * (-1.0 if desc else 1.0)).alias("key"))
        for name, col, desc in RANKING_CRITERIA]))
    long = market.select("city", rows.alias("r")).select("city", "r.*")
    w = Window.partitionBy("criterion").orderBy(F.col("key").asc_nulls_last(), "city")
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("criterion", F.col("rank").cast("int").alias("rank"), "city", "value"))


def settlement_price_ratio(market: DataFrame) -> DataFrame:
    """Spread of mean price per m2: max / min over the selected settlements."""
    return market.agg(
        F.max("avg_price_per_sqm").alias("max_price_per_sqm"),
        F.min("avg_price_per_sqm").alias("min_price_per_sqm"),
        round_half_up(safe_div(F.max("avg_price_per_sqm"), F.min("avg_price_per_sqm")), 2)
        .alias("price_ratio"))
