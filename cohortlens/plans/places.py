"""Restaurant market study: merge/dedup, 24/7 share, category / district
shares, chains, seats, ratings, top chains, bill by district.

Inputs: ``p_info`` (id, name, address, district, category, hours, rating,
chain, seats) and ``p_price`` (id, price, avg_bill, middle_avg_bill,
middle_coffee_cup).  ``places`` below is the merged, normalised and
deduplicated frame every later step reads.  pandas semantics kept: group
keys drop nulls, ``value_counts`` drops nulls, ``mode`` takes the smallest
most frequent value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.common import exact_avg, exact_sum, round_half_even, round_half_up, safe_div
from cohortlens.operators.dedup import all_duplicates, keep_one
from cohortlens.operators.describe import describe
from cohortlens.operators.quantiles import quantiles
from cohortlens.operators.scalar import with_scalars
from cohortlens.operators.shares import value_share

# --- fixed values: the study's normalised key columns and its 24/7 phrase
NORMALISED = ("name", "address", "district")
ROUND_THE_CLOCK = "ежедневно, круглосуточно"


def _merged(info: DataFrame, price: DataFrame, norm: Sequence[str]) -> DataFrame:
    m = info.join(price, "id", "full_outer")
    for c in norm:
        m = m.withColumn(c, F.lower(F.col(c)))
    return m


def merge_and_dedup(info: DataFrame, price: DataFrame, norm: Sequence[str] = NORMALISED,
                    keep: str = "last", phrase: str = ROUND_THE_CLOCK) -> DataFrame:
    """Full outer merge on id, lower-case text keys, keep the last row (by id,
    the merge order) per (name, address, district); adds ``is_24_7``."""
    m = _merged(info, price, norm)
    d = keep_one(m, list(norm), "id", keep)
    return d.withColumn("is_24_7", F.coalesce(F.lower(F.col("hours")).contains(phrase), F.lit(False)))


def merge_duplicates(info: DataFrame, price: DataFrame, norm: Sequence[str] = NORMALISED) -> DataFrame:
    """Every merged row whose normalised key occurs more than once."""
    return all_duplicates(_merged(info, price, norm), list(norm))


def round_the_clock_share(places: DataFrame, dp: int = 2) -> DataFrame:
    g = places.agg(F.sum(F.col("is_24_7").cast("int")).cast("long").alias("count_24_7"),
                   F.count(F.lit(1)).alias("total"))
    return g.select("count_24_7", "total",
                    round_half_up(safe_div(F.col("count_24_7") * 100.0, "total"), dp).alias("pct"))


def share_of_rows(places: DataFrame, col: str, where: Column | None = None, dp: int = 2) -> DataFrame:
    """``value_counts`` of ``col`` with the share of *all* rows (nulls included
    in the denominator, as ``count / len(df)``)."""
    x = places if where is None else places.where(where)
    g = x.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    tot = x.agg(F.count(F.lit(1)).alias("__t"))
    return with_scalars(g, tot).select(
        "value", "count", round_half_even(safe_div(F.col("count") * 100.0, "__t"), dp).alias("pct"))


def category_share(places: DataFrame, where: Column | None = None, dp: int = 2) -> DataFrame:
    return value_share(places, "category", where, dp=dp, rounding=round_half_even)


def chain_share(places: DataFrame, by: str = "category", dp: int = 1) -> DataFrame:
    """Independent vs chain counts per ``by`` value and the chain share."""
    x = places.where(F.col(by).isNotNull())
    g = x.groupBy(by).agg(F.count(F.when(F.col("chain") == 0, 1)).alias("independent"),
                          F.count(F.when(F.col("chain") == 1, 1)).alias("chain"))
    g = g.withColumn("total", F.col("independent") + F.col("chain"))
    return g.select(by, "independent", "chain", "total",
                    round_half_even(safe_div(F.col("chain") * 100.0, "total"), dp).alias("chain_pct"))


def chain_share_overall(places: DataFrame, dp: int = 1) -> DataFrame:
    g = places.agg(F.count(F.when(F.col("chain") == 0, 1)).alias("independent"),
                   F.count(F.when(F.col("chain") == 1, 1)).alias("chain"),
                   F.count(F.lit(1)).alias("rows"))
    return g.select("independent", "chain", "rows",
                    round_half_up(safe_div(F.col("independent") * 100.0, "rows"), dp).alias("independent_pct"),
                    round_half_up(safe_div(F.col("chain") * 100.0, "rows"), dp).alias("chain_pct"))


def seats_summary(places: DataFrame, dp: int = 4) -> DataFrame:
    """Typical seats per category: interpolated median of non-null seats."""
    x = places.where(F.col("category").isNotNull())
    q = quantiles(x, "seats", {"median_seats": .5}, ["category"], kind="cont")
    return q.select("category", round_half_up("median_seats", dp).alias("median_seats"))


def seats_describe(places: DataFrame) -> DataFrame:
    return describe(places, "seats")


def seats_large(places: DataFrame, threshold: float = 300) -> DataFrame:
    return places.where(F.col("seats") > threshold).select("id", "name", "category", "seats")


def rating_by_category(places: DataFrame, dp: int = 2) -> DataFrame:
    g = places.where(F.col("category").isNotNull()).groupBy("category").agg(exact_avg("rating").alias("r"))
    return g.select("category", round_half_even("r", dp).alias("avg_rating"))


def rating_describe(places: DataFrame) -> DataFrame:
    return describe(places, "rating")


def rating_by_price(places: DataFrame, dp: int = 4) -> DataFrame:
    g = places.where(F.col("price").isNotNull()).groupBy("price").agg(exact_avg("rating").alias("r"))
    return g.select("price", round_half_up("r", dp).alias("avg_rating"))


def top_chains(places: DataFrame, k: int = 15, dp: int = 4) -> DataFrame:
    """Chains with the most venues: count, mean rating, modal category.

    Two small aggregates, no join: (chain, category) counts and rating sums,
    then per chain the totals and the modal category - most frequent, the
    smallest category on ties (pandas ``mode()[0]``), null categories ignored.
    """
    x = places.where((F.col("chain") == 1) & F.col("name").isNotNull())
    per_cat = x.groupBy("name", "category").agg(
        F.count(F.lit(1)).alias("n"), exact_sum("rating").alias("s"), F.count("rating").alias("c"))
    mode_key = F.when(F.col("category").isNotNull(), F.struct(-F.col("n"), F.col("category")))
    per_chain = per_cat.groupBy("name").agg(
        F.sum("n").alias("count"), safe_div(F.sum("s"), F.sum("c")).alias("r"),
        F.min_by("category", mode_key).alias("category"))
    top = per_chain.orderBy(F.col("count").desc(), F.col("name").asc()).limit(k)
    return top.select("name", F.col("count").cast("long").alias("count"),
                      round_half_up("r", dp).alias("avg_rating"), "category")


def top_chain_categories(places: DataFrame, k: int = 15) -> DataFrame:
    t = top_chains(places, k)
    return t.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("chains"))


def bill_vs_center(places: DataFrame, center: str, dp: int = 4) -> DataFrame:
    """Mean ``middle_avg_bill`` per district and the gap to the centre's mean."""
    g = (places.where(F.col("district").isNotNull()).groupBy("district")
         .agg(exact_avg("middle_avg_bill").alias("b")))
    c = F.max(F.when(F.col("district") == center, F.col("b"))).over(Window.partitionBy())
    return g.select("district", round_half_up("b", dp).alias("avg_bill"),
                    round_half_up(c - F.col("b"), dp).alias("gap_to_center"))


# ---------------------------------------------------------------- association
ASSOC_COLS = ("rating", "category", "district", "chain", "seats", "price", "is_24_7")
ASSOC_INTERVAL = ("rating", "chain", "seats")


def rating_association(places: DataFrame, with_phik: bool = True) -> DataFrame:
    from cohortlens.operators.assoc import chi2_matrix, phik_matrix
    if with_phik:
        return phik_matrix(places, ASSOC_COLS, ASSOC_INTERVAL, bins=10)
    return chi2_matrix(places, ASSOC_COLS, ASSOC_INTERVAL, bins=10)
