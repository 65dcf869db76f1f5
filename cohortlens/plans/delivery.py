"""Food-delivery product metrics: DAU, conversion, average check, LTV, retention.

Inputs are the ``d_*`` adapter views (events, sales, cities, partners,
dishes).  The city is a name looked up in ``cities``; all date windows are
inclusive (SQL ``BETWEEN``).

Plan shape: the city lookup is a tiny, filtered dimension and is broadcast
into a left-semi join (the fact side is never shuffled for it); distinct
counts aggregate on (key, user) first, so a hot day or city is spread over
users; top-k results use ``orderBy().limit()`` (TakeOrderedAndProject) with
key tie-breakers so ties resolve the same way in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.common import exact_sum, round_half_up, safe_div


def _distinct(col, approx_rsd: float | None):
    """Exact distinct count, or HyperLogLog++ with relative error
    ``approx_rsd`` (opt-in: one fixed-size sketch per group instead of a
    (group, user) shuffle)."""
    return F.countDistinct(col) if approx_rsd is None else F.approx_count_distinct(col, approx_rsd)


def _in_city(facts: DataFrame, cities: DataFrame, city: str) -> DataFrame:
    ids = cities.where(F.col("city_name") == city).select("city_id")
    # The planner broadcasts the filtered dimension if its size allows.
    return facts.join(ids, "city_id", "left_semi")


def dau(events: DataFrame, cities: DataFrame, city: str, start: str, end: str,
        limit: int = 10, approx_rsd: float | None = None) -> DataFrame:
    """Daily distinct ordering users in one city (first ``limit`` days)."""
    ev = _in_city(events, cities, city).where(
        (F.col("event") == "order") & F.col("user_id").isNotNull()
        & F.col("log_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return (ev.groupBy("log_date").agg(_distinct(F.col("user_id"), approx_rsd).alias("dau"))
            .orderBy("log_date").limit(limit))


def conversion_rate(events: DataFrame, cities: DataFrame, city: str, start: str, end: str,
                    limit: int = 10, approx_rsd: float | None = None) -> DataFrame:
    """Daily ordering users / all active users, rounded to 2 dp."""
    ev = _in_city(events, cities, city).where(
        F.col("log_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    agg = ev.groupBy("log_date").agg(
        _distinct(F.when(F.col("event") == "order", F.col("user_id")), approx_rsd).alias("buyers"),
        _distinct(F.col("user_id"), approx_rsd).alias("users"))
    return (agg.select("log_date", round_half_up(safe_div("buyers", "users"), 2).alias("cr"))
            .orderBy("log_date").limit(limit))


def _city_orders(sales: DataFrame, cities: DataFrame, city: str, start: str, end: str) -> DataFrame:
    s = _in_city(sales, cities, city).where(
        F.col("revenue").isNotNull()
        & F.col("log_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return s.withColumn("commission_revenue", F.col("revenue") * F.col("commission"))


def avg_check_monthly(sales: DataFrame, cities: DataFrame, city: str, start: str,
                      end: str) -> DataFrame:
    """Per month: distinct orders, commission sum, commission per order."""
    o = _city_orders(sales, cities, city, start, end)
    agg = (o.groupBy(F.trunc("log_date", "month").alias("month"))
           .agg(F.countDistinct("order_id").alias("orders"),
                exact_sum("commission_revenue").alias("s")))
    return agg.select("month", "orders", round_half_up("s", 2).alias("commission_sum"),
                      round_half_up(safe_div("s", "orders"), 2).alias("avg_check"))


def _restaurant_ltv(orders: DataFrame, partners: DataFrame) -> DataFrame:
    # Aggregate the fact side per (rest_id, city_id) before joining partners.
    per_rest = orders.groupBy("rest_id", "city_id").agg(exact_sum("commission_revenue").alias("s"))
    p = partners.select("rest_id", "city_id", "chain", "type")
    return (per_rest.join(p, ["rest_id", "city_id"])
            .groupBy("rest_id", "chain", "type").agg(exact_sum("s").alias("s"))
            .select("rest_id", "chain", "type", round_half_up("s", 2).alias("ltv")))


def ltv_top_restaurants(sales: DataFrame, cities: DataFrame, partners: DataFrame, city: str,
                        start: str, end: str, k: int = 3) -> DataFrame:
    """Restaurants with the largest commission revenue (top ``k``)."""
    o = _city_orders(sales, cities, city, start, end)
    return (_restaurant_ltv(o, partners)
            .orderBy(F.col("ltv").desc(), F.col("rest_id").asc()).limit(k))


def ltv_top_dishes(sales: DataFrame, cities: DataFrame, partners: DataFrame, dishes: DataFrame,
                   city: str, start: str, end: str, k_rest: int = 2, k: int = 5) -> DataFrame:
    """Top ``k`` dishes by commission inside the ``k_rest`` best restaurants."""
    o = _city_orders(sales, cities, city, start, end)
    # The k_rest winners are a parameter-bounded result (k_rest ids), fetched
    # once and used as a literal IN-list: the filter then reaches the Parquet
    # scan of the fact table (pushed predicate on the restaurant key) and the
    # dish-level aggregation reads only those restaurants' rows.
    top_ids = [r["rest_id"] for r in
               _restaurant_ltv(o, partners).orderBy(F.col("ltv").desc(), F.col("rest_id").asc())
               .limit(k_rest).select("rest_id").collect()]
    o = o.where(F.col("rest_id").isin(top_ids))
    per_dish = o.groupBy("rest_id", "city_id", "object_id").agg(exact_sum("commission_revenue").alias("s"))
    p = partners.select("rest_id", "city_id", "chain")
    d = (dishes.select("object_id", "rest_id", "name", "spicy", "fish", "meat")
         .where(F.col("rest_id").isin(top_ids)))
    j = per_dish.join(p, ["rest_id", "city_id"]).join(d, ["object_id", "rest_id"])
    g = (j.groupBy("chain", F.col("name").alias("dish"), "spicy", "fish", "meat")
         .agg(round_half_up(exact_sum("s"), 2).alias("ltv")))
    return g.orderBy(F.col("ltv").desc(), "chain", "dish", "spicy", "fish", "meat").limit(k)


def _retention_pairs(events: DataFrame, cities: DataFrame, city: str, cohort: tuple[str, str],
                     activity: tuple[str, str], days: int) -> DataFrame:
    ev = _in_city(events, cities, city)
    d = lambda s: F.lit(s).cast("date")
    new_users = (ev.where(F.col("first_date").between(d(cohort[0]), d(cohort[1])))
                 .select("first_date", "user_id").distinct())
    active = (ev.where(F.col("log_date").between(d(activity[0]), d(activity[1])))
              .select("log_date", "user_id").distinct())
    j = new_users.join(active, (new_users.user_id == active.user_id)
                       & (active.log_date >= new_users.first_date))
    return (j.select(new_users.user_id, "first_date",
                     F.datediff("log_date", "first_date").alias("day_since_install"))
            .where(F.col("day_since_install") < days))


def retention_daily(events: DataFrame, cities: DataFrame, city: str, cohort: tuple[str, str],
                    activity: tuple[str, str], days: int = 8) -> DataFrame:
    """Retained users by day since install; rate vs the running maximum."""
    r = _retention_pairs(events, cities, city, cohort, activity, days)
    g = r.groupBy("day_since_install").agg(F.countDistinct("user_id").alias("retained_users"))
    # At most ``days`` rows remain: the un-partitioned running window is cheap.
    w = Window.orderBy("day_since_install")
    return g.select("day_since_install", "retained_users",
                    round_half_up(safe_div("retained_users", F.max("retained_users").over(w)), 2)
                    .alias("retention_rate"))


def retention_by_month(events: DataFrame, cities: DataFrame, city: str, cohort: tuple[str, str],
                       activity: tuple[str, str], days: int = 8) -> DataFrame:
    """Same as ``retention_daily`` split by the install month of the cohort."""
    r = _retention_pairs(events, cities, city, cohort, activity, days)
    g = (r.groupBy(F.trunc("first_date", "month").alias("month"), "day_since_install")
         .agg(F.countDistinct("user_id").alias("retained_users")))
    w = Window.partitionBy("month").orderBy("day_since_install")
    return g.select("month", "day_since_install", "retained_users",
                    round_half_up(safe_div("retained_users", F.max("retained_users").over(w)), 2)
                    .alias("retention_rate"))
