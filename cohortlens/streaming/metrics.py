"""Event-time streaming versions of DAU and daily conversion.

The batch operators count distinct users per day exactly; on a stream the
state of an open day must be bounded by a watermark:

* ``streaming_dau`` is exact: ``dropDuplicatesWithinWatermark`` keeps one
  event per (user, day) - the state is the set of user-days still inside
  the watermark - and a tumbling one-day window counts them.  Append mode
  emits a day once the watermark passes its end.
* ``streaming_conversion`` keeps two HyperLogLog++ sketches per day
  (``approx_count_distinct``), because a ratio of two exact distinct counts
  would need two deduplicating states joined back together; the relative
  error is set by ``rsd``.

Both read any streaming DataFrame with an event-time column, e.g.
``spark.readStream.schema(s).parquet(dir)`` or a Kafka source.  On a cluster,
start the query with ``checkpointLocation`` in the shared folder named by
``spark.checkpoint.dir`` so the deduplication and window state survive
executor and driver restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def streaming_dau(events: DataFrame, ts: str = "ts", user: str = "user_id", watermark: str = "1 day",
                  event_filter=None) -> DataFrame:
    # A shorter watermark would drop a user's state inside the day and count
    # a later event of that user again.
    if not events.sparkSession.sql(f"SELECT timestamp'2000-01-01' + INTERVAL '{watermark}' >= timestamp'2000-01-02'").first()[0]:
        raise ValueError("the watermark must be at least one day")
    ev = events if event_filter is None else events.where(event_filter)
    ev = (ev.select(F.col(ts).cast("timestamp").alias("event_time"), F.col(user).alias("user_id"))
          .where(F.col("user_id").isNotNull())
          .withColumn("day", F.to_date("event_time"))
          .withWatermark("event_time", watermark)
          .dropDuplicatesWithinWatermark(["user_id", "day"]))
    g = ev.groupBy(F.window("event_time", "1 day")).agg(F.count(F.lit(1)).alias("dau"))
    return g.select(F.to_date(F.col("window.start")).alias("log_date"), "dau")


def streaming_conversion(events: DataFrame, ts: str = "ts", user: str = "user_id", event: str = "event_type",
                         order_value: str = "purchase", watermark: str = "1 day", rsd: float = 0.01) -> DataFrame:
    ev = (events.select(F.col(ts).cast("timestamp").alias("event_time"), F.col(user).alias("user_id"),
                        F.col(event).alias("event"))
          .withWatermark("event_time", watermark))
    g = ev.groupBy(F.window("event_time", "1 day")).agg(
        F.approx_count_distinct(F.when(F.col("event") == order_value, F.col("user_id")), rsd).alias("buyers"),
        F.approx_count_distinct("user_id", rsd).alias("users"))
    return g.select(F.to_date(F.col("window.start")).alias("log_date"), "buyers", "users",
                    F.round(F.try_divide(F.col("buyers").cast("double"), F.col("users")), 2).alias("cr"))
