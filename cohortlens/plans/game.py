"""In-game purchase study (specification only: questions and published
results; the query text is not part of the source study).

Inputs: ``g_users`` (id, race, payer 0/1), ``g_events`` (transaction_id, id,
item_code, amount) and ``g_items`` (item_code, game_items).  As stated in
the study, zero-amount purchases are reported (``zero_purchases``) and then
excluded from every later step; the published item shares reproduce only
with that denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.common import exact_avg, exact_sum, round_half_up, safe_div
from cohortlens.operators.ranks import Distribution
from cohortlens.operators.scalar import scalar_frame, with_scalars


def payer_share(users: DataFrame, dp: int = 4) -> DataFrame:
    g = users.agg(F.count(F.lit(1)).alias("players"), F.sum("payer").cast("long").alias("payers"))
    return g.select("players", "payers", round_half_up(safe_div("payers", "players"), dp).alias("share"))


def payer_share_by_race(users: DataFrame, total_row: bool = True, dp: int = 4) -> DataFrame:
    """Players, payers and payer share per race, plus an overall row (rollup)."""
    if total_row:
        g = users.rollup("race").agg(F.count(F.lit(1)).alias("players"),
                                     F.sum("payer").cast("long").alias("payers"),
                                     F.grouping("race").alias("g"))
        race = F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("race"))
    else:
        g = users.groupBy("race").agg(F.count(F.lit(1)).alias("players"),
                                      F.sum("payer").cast("long").alias("payers"))
        race = F.col("race")
    return g.select(race.alias("race"), "players", "payers",
                    round_half_up(safe_div("payers", "players"), dp).alias("share"))


def purchase_stats(purchases: DataFrame, dp: int = 4) -> DataFrame:
    """count, min, max, mean, interpolated median and sample std of amounts."""
    amounts = Distribution.of(purchases, "amount")
    found = with_scalars(amounts.moments(), amounts.quantiles({"median": .5}))
    return found.select(
        "count", "min", "max", round_half_up("mean", dp).alias("mean"), round_half_up("median", dp).alias("median"),
        round_half_up("std", dp).alias("std"))


def zero_purchases(purchases: DataFrame, dp: int = 4) -> DataFrame:
    g = purchases.agg(F.count(F.when(F.col("amount") == 0, 1)).alias("zero_count"),
                      F.count(F.lit(1)).alias("n"))
    return g.select("zero_count", round_half_up(safe_div(F.col("zero_count") * 100.0, "n"), dp).alias("zero_pct"))


def _paid(purchases: DataFrame) -> DataFrame:
    return purchases.where(F.col("amount") > 0)


def _per_buyer(purchases: DataFrame) -> DataFrame:
    # First level of the two-level aggregate: one row per buying user.
    return _paid(purchases).groupBy("id").agg(F.count(F.lit(1)).alias("n"), exact_sum("amount").alias("s"))


def buyers_by_payer(users: DataFrame, purchases: DataFrame, dp: int = 2) -> DataFrame:
    """Buyers, purchases per buyer and spend per buyer for payers vs non-payers."""
    pb = _per_buyer(purchases).join(users.select("id", "payer"), "id")
    g = pb.groupBy("payer").agg(F.count(F.lit(1)).alias("buyers"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    return g.select("payer", "buyers", round_half_up(safe_div("n", "buyers"), dp).alias("purchases_per_buyer"),
                    round_half_up(safe_div("s", "buyers"), dp).alias("spend_per_buyer"))


def item_popularity(users: DataFrame, purchases: DataFrame, items: DataFrame, k: int | None = None,
                    dp: int = 2) -> DataFrame:
    """Sales per item, share of all paid purchases and share of players who
    bought it at least once."""
    p = _paid(purchases)
    per_item = p.groupBy("item_code").agg(F.count(F.lit(1)).alias("sales"),
                                          F.countDistinct("id").alias("buyers"))
    totals = scalar_frame(p.agg(F.count(F.lit(1)).alias("__sales")),
                          users.agg(F.count(F.lit(1)).alias("__players")))
    j = (with_scalars(per_item.join(items, "item_code", "left"), totals)
         .select(F.col("game_items").alias("item"), "item_code", "sales",
                 round_half_up(safe_div(F.col("sales") * 100.0, "__sales"), dp).alias("sales_share"),
                 round_half_up(safe_div(F.col("buyers") * 100.0, "__players"), dp).alias("player_share")))
    if k is not None:
        j = j.orderBy(F.col("sales").desc(), F.col("item_code").asc()).limit(k)
    return j


def race_activity(users: DataFrame, purchases: DataFrame, dp: int = 4) -> DataFrame:
    """Per race: players, buyers, buyer share, payer share among buyers,
    purchases per buyer, amount per purchase, spend per buyer."""
    pb = _per_buyer(purchases)
    u = users.select("id", "race", "payer").join(pb, "id", "left")
    is_buyer = F.col("n").isNotNull()
    g = u.groupBy("race").agg(
        F.count(F.lit(1)).alias("players"), F.count(F.when(is_buyer, 1)).alias("buyers"),
        F.count(F.when(is_buyer & (F.col("payer") == 1), 1)).alias("paying_buyers"),
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    r = lambda c: round_half_up(c, dp)
    return g.select("race", "players", "buyers",
                    r(safe_div("buyers", "players")).alias("buyer_share"),
                    r(safe_div("paying_buyers", "buyers")).alias("payer_share"),
                    r(safe_div("n", "buyers")).alias("purchases_per_buyer"),
                    r(safe_div("s", "n")).alias("amount_per_purchase"),
                    r(safe_div("s", "buyers")).alias("spend_per_buyer"))


def activity_tiers(activity: DataFrame, bounds: Sequence[float] = (70, 80, 100)) -> DataFrame:
    """Bucket races by purchases per buyer using the stated bounds:
    > hi very active, [mid, hi] active, [lo, mid) medium, below lo low."""
    lo, mid, hi = bounds
    ppb = F.col("purchases_per_buyer")
    tier = (F.when(ppb > hi, "very_active").when(ppb >= mid, "active")
             .when(ppb >= lo, "medium").otherwise("low"))
    return activity.select("race", "purchases_per_buyer", tier.alias("tier"))
