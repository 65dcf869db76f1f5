"""Cohort hygiene and A/B evaluation for an event log with a participants
registry, plus the per-user hours study (dedup, describe, Welch test).

Inputs: ``t_participants`` (user_id, grp, ab_test), ``t_events`` (user_id,
event_dt, event_name, details) and ``b_user_hours`` (row_idx, puid, city,
hours).  Key-set filters (``isin`` / ``~isin`` in the study) are semi / anti
joins against distinct key frames: ids are never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.common import floor_days, round_half_up, safe_div
from cohortlens.operators import hypothesis as H
from cohortlens.operators.dedup import duplicate_count, keep_one
from cohortlens.operators.describe import density_histogram, describe


# ---------------------------------------------------------------- per-user hours
def dedup_users(df: DataFrame, key: str = "puid", order: str = "row_idx", keep: str = "first") -> DataFrame:
    """Drop repeated user ids, keeping the first row in file order."""
    return keep_one(df, key, order, keep)


def dedup_users_count(df: DataFrame, key: str = "puid") -> DataFrame:
    return duplicate_count(df, key)


def group_describe(df: DataFrame, group: str, value: str) -> DataFrame:
    return describe(df, value, [group])


def welch_ttest(df: DataFrame, group: str, value: str, a, b, alternative: str = "greater",
                alpha: float = 0.05) -> DataFrame:
    """One-sided Welch test: is the mean of arm ``a`` larger than arm ``b``'s?"""
    return H.ttest_ind(df, group, value, a, b, equal_var=False, alternative=alternative, alpha=alpha)


def hours_histogram(df: DataFrame, group: str, value: str, bins: int = 30) -> DataFrame:
    return density_histogram(df, value, [group], bins)


# ---------------------------------------------------------------- participants / events
def _relevant(participants: DataFrame, test: str) -> DataFrame:
    """Distinct enrolments of users enrolled in exactly one test, for ``test``.

    One aggregate per user: the set of the user's distinct (group, test)
    enrolments - bounded per user by tests x groups and de-duplicated
    map-side - replaces a full-row DISTINCT, a per-user distinct count and
    an anti join.
    """
    per_user = participants.groupBy("user_id").agg(
        F.collect_set(F.struct("grp", "ab_test")).alias("enrolments"))
    tests = F.array_distinct(F.filter(F.transform("enrolments", lambda e: e["ab_test"]),
                                      lambda t: t.isNotNull()))
    rows = (per_user.where(F.size(tests) <= 1)
            .select("user_id", F.explode("enrolments").alias("e"))
            .select("user_id", "e.grp", "e.ab_test"))
    return rows.where(F.col("ab_test") == test)


def clean_participants(participants: DataFrame, test: str) -> DataFrame:
    """Full-row dedup, drop users enrolled in more than one test, keep ``test``."""
    return _relevant(participants, test).select("user_id", "grp", "ab_test")


def clean_participants_groups(participants: DataFrame, test: str) -> DataFrame:
    return (_relevant(participants, test).groupBy("grp")
            .agg(F.count(F.lit(1)).alias("users")))


def participants_duplicates(participants: DataFrame) -> DataFrame:
    return duplicate_count(participants)


def events_duplicates(events: DataFrame) -> DataFrame:
    """Repeated rows of the event log."""
    return duplicate_count(events)


def crossover(participants: DataFrame, test: str) -> DataFrame:
    """Check after cleaning: users that are still in both groups of the test."""
    per_user = _relevant(participants, test).groupBy("user_id").agg(
        F.min("grp").alias("a"), F.max("grp").alias("b"))
    return per_user.agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("users_in_both_groups"),
                        F.count(F.lit(1)).alias("users"))


def lifetime_events(events: DataFrame, participants: DataFrame, test: str, horizon_days: int = 7,
                    allow_negative: bool = True) -> DataFrame:
    """Events of the test's users within ``horizon_days`` of first registration.

    Lifetime is whole days floored (events before registration get negative
    days and pass unless ``allow_negative=False``); users without a
    registration have a null lifetime and are dropped by the comparison.
    """
    ids = _relevant(participants, test).select("user_id").distinct()
    # Only the test's users reach the shuffle of the distinct.
    ev = events.join(ids, "user_id", "left_semi").distinct()
    # A minimum ignores duplicates: the registration branch reads the event
    # log directly (pre-filtered to registrations) instead of the DISTINCT.
    first = (events.where(F.col("event_name") == "registration").join(ids, "user_id", "left_semi")
             .groupBy("user_id").agg(F.min("event_dt").alias("registration_dt")))
    x = ev.join(first, "user_id", "left").withColumn(
        "lifetime_days", floor_days("event_dt", "registration_dt"))
    cond = F.col("lifetime_days") < horizon_days
    if not allow_negative:
        cond = cond & (F.col("lifetime_days") >= 0)
    return x.where(cond).select("user_id", "event_dt", "event_name", "details", "registration_dt",
                                "lifetime_days")


def _buyers(events: DataFrame, participants: DataFrame, test: str, horizon_days: int | None) -> DataFrame:
    """Users and distinct buyers per group, in one aggregate.

    Buyers are the distinct users with a purchase (duplicate events cannot
    change a distinct count, so the event log is not de-duplicated here);
    they are left-joined to the test's (user, group) enrolments.
    """
    rel = _relevant(participants, test).select("user_id", "grp").distinct()
    if horizon_days is None:
        # As in the study: conversion uses all events of the participants.
        ev = events
    else:
        ev = lifetime_events(events, participants, test, horizon_days)
    bought = (ev.where(F.col("event_name") == "purchase").select("user_id").distinct()
              .withColumn("__bought", F.lit(True)))
    j = rel.join(bought, "user_id", "left")
    return j.groupBy("grp").agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct(F.when(F.col("__bought"), F.col("user_id"))).alias("buyers"))


def group_conversion(events: DataFrame, participants: DataFrame, test: str,
                     horizon_days: int | None = None, goal: float = 0.33, dp: int = 4) -> DataFrame:
    """Buyers / users per group in percent; ``goal_reached`` compares the
    fraction with the fractional goal."""
    g = _buyers(events, participants, test, horizon_days)
    conv = safe_div("buyers", "users")
    return g.select("grp", "users", "buyers", round_half_up(conv * 100.0, dp).alias("conversion_pct"),
                    (conv >= goal).alias("goal_reached"))


def conversion_ztest(events: DataFrame, participants: DataFrame, test: str, treat: str = "B",
                     control: str = "A", alternative: str = "larger", alpha: float = 0.05) -> DataFrame:
    g = _buyers(events, participants, test, None)

    def pick(arm, c):
        return F.max(F.when(F.col("grp") == arm, F.col(c)))

    counts = g.agg(pick(treat, "buyers").alias("s1"), pick(treat, "users").alias("n1"),
                   pick(control, "buyers").alias("s2"), pick(control, "users").alias("n2"))
    return H.proportions_ztest(counts, alternative, alpha)
