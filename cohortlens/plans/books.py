"""Audiobook-service metrics: MAU by author / title, fixed-cohort retention,
subscription LTV, revenue per listened hour, per-user hours mart.

Inputs: ``b_audition`` (puid, msk_business_dt, main_content_id,
usage_geo_id, hours), ``b_content``, ``b_author``, ``b_geo``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.common import exact_sum, round_half_up, safe_div


def _month_listens(audition: DataFrame, month: int, year: int | None) -> DataFrame:
    d = F.col("msk_business_dt")
    cond = F.month(d) == month
    if year is not None:
        cond = cond & (F.year(d) == year)
    return audition.where(cond).select("puid", "main_content_id")


def _catalog(content: DataFrame, author: DataFrame) -> DataFrame:
    # content -> author is a dimension-to-dimension join; both sides are
    # catalogue tables, joined once before meeting the fact side.
    return content.join(author, "main_author_id")


def _distinct(col: str, approx_rsd: float | None):
    # Exact by default; HyperLogLog++ sketches per group when opted in.
    return F.countDistinct(col) if approx_rsd is None else F.approx_count_distinct(col, approx_rsd)


def mau_authors(audition: DataFrame, content: DataFrame, author: DataFrame, month: int = 11,
                year: int | None = None, k: int = 3, approx_rsd: float | None = None) -> DataFrame:
    """Distinct monthly listeners per author, top ``k``."""
    u = _month_listens(audition, month, year)
    cat = _catalog(content, author).select("main_content_id", "main_author_name")
    g = (u.join(cat, "main_content_id").groupBy("main_author_name")
         .agg(_distinct("puid", approx_rsd).alias("mau")))
    return g.orderBy(F.col("mau").desc(), "main_author_name").limit(k)


def mau_content(audition: DataFrame, content: DataFrame, author: DataFrame, month: int = 11,
                year: int | None = None, k: int = 3, approx_rsd: float | None = None) -> DataFrame:
    """Distinct monthly listeners per title (with topics and author), top ``k``."""
    u = _month_listens(audition, month, year)
    cat = _catalog(content, author).select("main_content_id", "main_content_name",
                                            "published_topic_title_list", "main_author_name")
    keys = ["main_content_name", "published_topic_title_list", "main_author_name"]
    g = u.join(cat, "main_content_id").groupBy(*keys).agg(_distinct("puid", approx_rsd).alias("mau"))
    return g.orderBy(F.col("mau").desc(), *keys).limit(k)


def retention_fixed_cohort(audition: DataFrame, cohort_day: str) -> DataFrame:
    """Users active on ``cohort_day`` and how many of them return each later day.

    The rate divides by the global maximum over all days (``MAX() OVER ()``),
    computed on the already-aggregated day rows.
    """
    day = F.lit(cohort_day).cast("date")
    cohort = audition.where(F.col("msk_business_dt") == day).select("puid").distinct()
    acts = (audition.where(F.col("msk_business_dt") >= day).select("puid", "msk_business_dt")
            .join(cohort, "puid"))
    g = (acts.groupBy(F.datediff("msk_business_dt", day).alias("day_since_install"))
         .agg(F.countDistinct("puid").alias("retained_users")))
    return g.select("day_since_install", "retained_users",
                    round_half_up(safe_div("retained_users",
                                           F.max("retained_users").over(Window.partitionBy())), 2)
                    .alias("retention_rate"))


def _city_listens(audition: DataFrame, geo: DataFrame, cities: Sequence[str]) -> DataFrame:
    g = geo.where(F.col("usage_geo_id_name").isin(list(cities))).select(
        "usage_geo_id", F.col("usage_geo_id_name").alias("city"))
    # geo is a fixed-size dimension (one row per region id): broadcast.
    return audition.join(g, "usage_geo_id")


def ltv_subscription(audition: DataFrame, geo: DataFrame, cities: Sequence[str],
                     price: float = 399) -> DataFrame:
    """Users and price x mean active months per city."""
    a = _city_listens(audition, geo, cities)
    per_user = (a.groupBy("city", "puid")
                .agg(F.countDistinct(F.trunc("msk_business_dt", "month")).alias("active_months")))
    g = per_user.groupBy("city").agg(F.count("puid").alias("total_users"),
                                     F.sum("active_months").alias("m"))
    return g.select("city", "total_users",
                    round_half_up(safe_div(F.col("m") * F.lit(float(price)), "total_users"), 2)
                    .alias("ltv"))


def avg_hour_revenue(audition: DataFrame, start: str, end: str, price: float = 399) -> DataFrame:
    """Per month in [start, end): MAU, listened hours, MAU x price / hours."""
    d = F.col("msk_business_dt")
    a = audition.where((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))
    g = (a.groupBy(F.trunc(d, "month").alias("month"))
         .agg(F.countDistinct("puid").alias("mau"), exact_sum("hours").alias("h")))
    return g.select("month", "mau", round_half_up("h", 2).alias("hours"),
                    round_half_up(safe_div(F.col("mau") * F.lit(float(price)), "h"), 2)
                    .alias("avg_hour_rev"))


def user_hours_by_city(audition: DataFrame, geo: DataFrame, cities: Sequence[str]) -> DataFrame:
    """Hours per (city, user): the mart handed to the hypothesis tests."""
    a = _city_listens(audition, geo, cities)
    return (a.groupBy("city", "puid").agg(exact_sum("hours").alias("h"))
            .select("city", "puid", round_half_up("h", 2).alias("hours")))
