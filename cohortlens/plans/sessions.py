"""A/B-test design, monitoring and evaluation over a sessions table.

Input: ``a_sessions`` (user_id, session_id, session_date, session_start_ts,
install_date, session_number, registration_flag, page_counter, region,
device, test_group).  Every metric is a distributed aggregate; the few
remaining rows (days, groups, attribute values) feed closed-form statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.common import round_half_up, round_half_even, safe_div
from cohortlens.operators import hypothesis as H
from cohortlens.operators.ranks import Distribution
from cohortlens.operators.scalar import with_scalars


def top_user_sessions(sessions: DataFrame) -> DataFrame:
    """All rows of the user with the most distinct sessions (smallest id on ties),
    numbered in the order of time.

    The session log is read twice: for the user's id, then for that user's rows.
    """
    per_user = sessions.groupBy("user_id").agg(F.countDistinct("session_id").alias("n"))
    top = per_user.orderBy(F.col("n").desc(), F.col("user_id").asc()).limit(1).select("user_id").collect()
    # One id (bounded), used as a literal so the filter is pushed to the scan.
    return with_session_number(sessions.where(F.col("user_id").isin([r["user_id"] for r in top])))


def with_session_number(sessions: DataFrame) -> DataFrame:
    """Adds ``session_number``: the place of a session among its user's, by time and id.

    Rows are ranked within (user, day) and start after the sessions of the
    user's earlier days, which are counted first, so that no task holds all
    sessions of a user.
    """
    days = sessions.groupBy("user_id", "session_date").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("user_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("user_id", "session_date", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("user_id", "session_date").orderBy("session_start_ts", "session_id")
    return (sessions.join(starts, ["user_id", "session_date"])
            .withColumn("session_number", (F.col("__before") + F.row_number().over(within)).cast("int"))
            .select(*sessions.columns, "session_number"))


def daily_registration(sessions: DataFrame, dp: int = 6) -> DataFrame:
    """Per day: distinct users, registrations (sum of the per-session flag), rate."""
    g = sessions.groupBy("session_date").agg(
        F.countDistinct("user_id").alias("daily_total_users"),
        F.sum("registration_flag").cast("long").alias("daily_registered_users"))
    return g.withColumn("daily_registration_rate",
                        round_half_up(safe_div("daily_registered_users", "daily_total_users"), dp))


def daily_registration_means(sessions: DataFrame, dp: int = 6) -> DataFrame:
    """Means over days of the three daily registration series."""
    g = sessions.groupBy("session_date").agg(
        F.countDistinct("user_id").alias("u"), F.sum("registration_flag").alias("r"))
    return g.agg(round_half_up(F.avg("u"), dp).alias("avg_total_users"),
                 round_half_up(F.avg("r"), dp).alias("avg_registered_users"),
                 round_half_up(F.avg(safe_div("r", "u")), dp).alias("avg_registration_rate"))


def page_counter_dist(sessions: DataFrame) -> DataFrame:
    """Sessions per number of viewed pages."""
    return sessions.groupBy("page_counter").agg(F.count("session_id").alias("session_count"))


def page_counter_stats(sessions: DataFrame, dp: int = 4) -> DataFrame:
    """Median (interpolated), mean and max pages per session."""
    pages = Distribution.of(sessions, "page_counter")
    found = with_scalars(pages.moments(), pages.quantiles({"median": .5}))
    return found.select(round_half_up("median", dp).alias("median_pages"), round_half_up("mean", dp).alias("mean_pages"),
                        F.col("max").cast(sessions.schema["page_counter"].dataType).alias("max_pages"))


def _good(min_pages: int):
    return (F.col("page_counter") >= min_pages).cast("int")


def daily_good_sessions(sessions: DataFrame, min_pages: int = 4, dp: int = 6) -> DataFrame:
    """Per day: sessions, sessions with >= ``min_pages`` pages, and their share."""
    g = sessions.groupBy("session_date").agg(
        F.count("session_id").alias("total_sessions"),
        F.sum(_good(min_pages)).cast("long").alias("good_sessions"))
    return g.withColumn("good_session_rate",
                        round_half_up(safe_div("good_sessions", "total_sessions"), dp))


def daily_good_sessions_stats(sessions: DataFrame, min_pages: int = 4, dp: int = 6) -> DataFrame:
    """Min / mean / max over days of the daily good-session share."""
    g = sessions.groupBy("session_date").agg(
        safe_div(F.sum(_good(min_pages)), F.count("session_id")).alias("r"))
    return g.agg(round_half_up(F.min("r"), dp).alias("min_rate"),
                 round_half_up(F.avg("r"), dp).alias("mean_rate"),
                 round_half_up(F.max("r"), dp).alias("max_rate"))


def good_rate_baselines(sessions: DataFrame, segment: str = "device",
                        min_pages: int = 4) -> DataFrame:
    """Baseline good-session share per segment plus an ``all`` row (rollup)."""
    g = sessions.rollup(segment).agg(F.avg(_good(min_pages).cast("double")).alias("baseline"))
    return g.select(F.coalesce(F.col(segment), F.lit("all")).alias("segment"), "baseline")


def required_sample_size(sessions: DataFrame, mde: float = 0.03, relative: bool = True,
                         alpha: float = 0.05, power: float = 0.8, rounding: str = "floor") -> DataFrame:
    """Sample size per group for each segment's own baseline."""
    return H.required_sample_size(good_rate_baselines(sessions), mde, relative, alpha, power, rounding)


def test_duration(sessions: DataFrame, n_per_group: DataFrame, groups: int = 2) -> DataFrame:
    """Days needed: ceil(groups * n / mean daily distinct users).

    The mean daily audience is rounded to a whole user as in the study
    (Python ``round``: half to even).
    """
    daily = sessions.groupBy("session_date").agg(F.countDistinct("user_id").alias("u"))
    avg = daily.agg(round_half_even(F.avg("u"), 0).alias("avg_daily_users"))
    n = n_per_group.select("n_per_group")
    return (with_scalars(avg, n)
            .select(F.col("avg_daily_users").cast("long").alias("avg_daily_users"), "n_per_group",
                    F.ceil(safe_div(F.col("n_per_group") * float(groups), "avg_daily_users"))
                    .cast("long").alias("days")))


def group_size_balance(sessions: DataFrame, group: str = "test_group", a: str = "A",
                       b: str = "B", dp: int = 2) -> DataFrame:
    """Distinct users per arm and the gap as a percentage of arm A."""
    g = sessions.where(F.col(group).isin(a, b)).groupBy(group).agg(F.countDistinct("user_id").alias("u"))
    r = g.agg(F.max(F.when(F.col(group) == a, F.col("u"))).alias("users_a"),
              F.max(F.when(F.col(group) == b, F.col("u"))).alias("users_b"))
    return r.select(F.coalesce("users_a", F.lit(0)).alias("users_a"),
                    F.coalesce("users_b", F.lit(0)).alias("users_b"),
                    round_half_up(safe_div(F.abs(F.col("users_a") - F.col("users_b")) * 100.0, "users_a"), dp)
                    .alias("pct_diff"))


def group_size_by_day(sessions: DataFrame, group: str = "test_group", a: str = "A",
                      b: str = "B") -> DataFrame:
    """Distinct users per day and arm, one column per arm (``unstack``).

    The pivot lists its values explicitly, so the output schema is static and
    Spark does not run an extra job to discover them; absent cells become 0.
    """
    p = (sessions.where(F.col(group).isin(a, b)).groupBy("session_date")
         .pivot(group, [a, b]).agg(F.countDistinct("user_id")))
    return (p.na.fill(0, [a, b])
            .select("session_date", F.col(a).cast("long").alias("users_a"),
                    F.col(b).cast("long").alias("users_b")))


def group_overlap(sessions: DataFrame, group: str = "test_group", a: str = "A",
                  b: str = "B") -> DataFrame:
    """Users per arm, users seen in both arms, users with more than one arm."""
    per_user = sessions.groupBy("user_id").agg(
        F.max((F.col(group) == a).cast("int")).alias("in_a"),
        F.max((F.col(group) == b).cast("int")).alias("in_b"),
        F.countDistinct(group).alias("k"))
    return per_user.agg(F.sum("in_a").cast("long").alias("users_a"),
                        F.sum("in_b").cast("long").alias("users_b"),
                        F.sum(F.col("in_a") * F.col("in_b")).cast("long").alias("in_both"),
                        F.sum((F.col("k") > 1).cast("int")).cast("long").alias("multi_group"))


def attribute_balance(sessions: DataFrame, attr: str, group: str = "test_group", a: str = "A",
                      b: str = "B", max_gap: float = 2.0, dp: int = 4) -> DataFrame:
    """Share (%) of users per attribute value inside each arm, the gap per
    value, the largest gap and whether it stays under ``max_gap`` points."""
    g = (sessions.where(F.col(group).isin(a, b)).groupBy(group, attr)
         .agg(F.countDistinct("user_id").alias("u")))
    g = g.withColumn("pct", safe_div(F.col("u") * 100.0, F.sum("u").over(Window.partitionBy(group))))
    p = g.groupBy(attr).agg(F.max(F.when(F.col(group) == a, F.col("pct"))).alias("pa"),
                            F.max(F.when(F.col(group) == b, F.col("pct"))).alias("pb"))
    p = p.select(F.col(attr).alias("value"), F.coalesce("pa", F.lit(0.0)).alias("pa"),
                 F.coalesce("pb", F.lit(0.0)).alias("pb"))
    # One row per attribute value: the global max is a window over a handful of rows.
    gap = F.abs(F.col("pa") - F.col("pb"))
    p = p.withColumn("gap", gap).withColumn("mx", F.max("gap").over(Window.partitionBy()))
    return p.select(F.lit(attr).alias("attr"), "value", round_half_up("pa", dp).alias("pct_a"),
                    round_half_up("pb", dp).alias("pct_b"), round_half_up("gap", dp).alias("abs_gap"),
                    round_half_up("mx", dp).alias("max_gap"), (F.col("mx") < max_gap).alias("balanced"))


def daily_sessions_ttest(sessions: DataFrame, group: str = "test_group", a: str = "A", b: str = "B",
                         alpha: float = 0.05) -> DataFrame:
    """Pooled two-sided t-test on daily distinct sessions per arm (days with
    no sessions in an arm are dropped for that arm, as ``dropna``)."""
    daily = (sessions.where(F.col(group).isin(a, b)).groupBy("session_date", group)
             .agg(F.countDistinct("session_id").alias("sessions")))
    return H.ttest_ind(daily, group, "sessions", a, b, equal_var=True, alternative="two-sided",
                       alpha=alpha)


def group_performance(sessions: DataFrame, group: str = "test_group", ref: str = "A",
                      min_pages: int = 4) -> DataFrame:
    """Sessions, good sessions and their share per arm (rounded to 4 dp, half
    to even, as the study); absolute and relative lift vs the ``ref`` arm."""
    g = sessions.groupBy(group).agg(F.count("session_id").alias("total_sessions"),
                                    F.sum(_good(min_pages)).cast("long").alias("good_sessions"),
                                    F.avg(_good(min_pages).cast("double")).alias("r"))
    g = g.withColumn("good_session_rate", round_half_even("r", 4))
    # Reference-row subtraction over a handful of arm rows.
    ref_rate = F.max(F.when(F.col(group) == ref, F.col("good_session_rate"))).over(Window.partitionBy())
    g = g.withColumn("ref", ref_rate)
    return g.select(group, "total_sessions", "good_sessions", "good_session_rate",
                    round_half_up(F.col("good_session_rate") - F.col("ref"), 6).alias("abs_diff"),
                    round_half_up(safe_div((F.col("good_session_rate") - F.col("ref")) * 100.0, "ref"), 6)
                    .alias("rel_diff_pct"))


def good_session_counts(sessions: DataFrame, group: str = "test_group", treat: str = "B",
                        control: str = "A", min_pages: int = 4) -> DataFrame:
    """(s1, n1, s2, n2): good sessions and sessions, treatment then control."""
    g = sessions.where(F.col(group).isin(treat, control)).groupBy(group).agg(
        F.sum(_good(min_pages)).alias("s"), F.count("session_id").alias("n"))

    def pick(arm, c):
        return F.max(F.when(F.col(group) == arm, F.col(c)))

    return g.agg(pick(treat, "s").alias("s1"), pick(treat, "n").alias("n1"),
                 pick(control, "s").alias("s2"), pick(control, "n").alias("n2"))


def proportions_ztest(sessions: DataFrame, alternative: str = "larger", alpha: float = 0.05) -> DataFrame:
    return H.proportions_ztest(good_session_counts(sessions), alternative, alpha)


def lift_confint(sessions: DataFrame, alpha: float = 0.05) -> DataFrame:
    return H.lift_confint(good_session_counts(sessions), alpha)
