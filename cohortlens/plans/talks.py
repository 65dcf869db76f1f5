"""Conference-talks dashboard (specification only: the study is a dashboard
spec; its queries are re-derived here).

Inputs: ``k_conferences`` (conference_id, conference, country) and
``k_talks`` (talk_id, conference_id, speaker, occupation, tags_text,
duration_min, views, applause, funny).  Tags are the space-separated words
of ``tags_text``; occupations are comma-separated.  Conferences without talks
are kept (left join) wherever conferences are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.common import round_half_up
from cohortlens.operators.scalar import with_scalars


def _conf_talks(conferences: DataFrame, talks: DataFrame) -> DataFrame:
    # conferences is a small dimension; keep every conference (left join).
    return conferences.join(talks, "conference_id", "left")


def _tags(talks: DataFrame) -> DataFrame:
    return (talks.select("talk_id", F.explode(F.split(F.col("tags_text"), " ")).alias("tag"))
            .where(F.col("tag") != ""))


def conference_totals(conferences: DataFrame, talks: DataFrame) -> DataFrame:
    j = _conf_talks(conferences, talks)
    totals = j.agg(F.countDistinct("conference_id").alias("conferences"),
                   F.countDistinct("talk_id").alias("talks"), F.countDistinct("speaker").alias("speakers"))
    tags = _tags(talks).agg(F.countDistinct("tag").alias("tags"))
    return with_scalars(totals, tags)


def conference_drilldown(conferences: DataFrame, talks: DataFrame, dp: int = 2) -> DataFrame:
    """Country -> conference roll-up: mean duration, max views, total
    applause, distinct speakers.  ``level`` is 0 for a conference, 1 for a
    country subtotal and 3 for the grand total."""
    j = _conf_talks(conferences, talks)
    g = j.rollup("country", "conference").agg(
        F.avg("duration_min").alias("d"), F.max("views").alias("max_views"),
        F.sum("applause").alias("applause"), F.countDistinct("speaker").alias("speakers"),
        F.grouping_id().alias("level"))
    return g.select("country", "conference", F.col("level").cast("int").alias("level"),
                    round_half_up("d", dp).alias("avg_duration"), "max_views",
                    F.col("applause").cast("long").alias("applause"), "speakers")


def top_funny_talks(talks: DataFrame, k: int = 10) -> DataFrame:
    return (talks.select("talk_id", "speaker", "funny")
            .orderBy(F.col("funny").desc(), F.col("talk_id").asc()).limit(k))


def top_tags(talks: DataFrame, k: int = 20) -> DataFrame:
    g = _tags(talks).groupBy("tag").agg(F.countDistinct("talk_id").alias("talks"))
    return g.orderBy(F.col("talks").desc(), F.col("tag").asc()).limit(k)


def occupations_by_applause(talks: DataFrame) -> DataFrame:
    occ = talks.select(F.explode(F.split(F.col("occupation"), ",")).alias("o"), "applause")
    return (occ.select(F.trim("o").alias("occupation"), "applause").where(F.col("occupation") != "")
            .groupBy("occupation").agg(F.sum("applause").cast("long").alias("applause")))


def speakers_and_length(conferences: DataFrame, talks: DataFrame, dp: int = 4) -> DataFrame:
    per_conf = (_conf_talks(conferences, talks).groupBy("conference_id")
                .agg(F.countDistinct("speaker").alias("s")))
    a = per_conf.agg(round_half_up(F.avg("s"), dp).alias("avg_speakers_per_conference"))
    b = talks.agg(round_half_up(F.avg("duration_min"), dp).alias("avg_duration"))
    return with_scalars(a, b)


def talk_detail(conferences: DataFrame, talks: DataFrame) -> DataFrame:
    return talks.join(conferences, "conference_id", "left").select(
        "talk_id", "conference_id", "conference", "country", "speaker", "occupation", "tags_text",
        "duration_min", "views", "applause", "funny")
