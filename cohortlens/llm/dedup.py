"""Exact deduplication with streaming state on disk.

A first pass writes, without a shuffle, one slim row per document: digest of
the text, identifier and content locator (file and row).  A Structured
Streaming aggregation over those rows keeps, per digest, the row that stays
and the number of rows in RocksDB state that never expires (no watermark); a
``state_dir`` given by the caller takes further rows later.  The state is
read back as a table.  Where a digest was hit more than once, the full bytes
of its rows, those of earlier calls found by their locators, are compared with
those of the row that stays, and rows that differ under one digest are grouped
again by their bytes.

Only rows whose digest may have been hit are shuffled with their texts: a
bitmap of hit digests (bounded, broadcast) lets all others
pass in the scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .common import materialize, maybe_among, placed, shared_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _state(spark: SparkSession, rows_path: str, schema: StructType, state_path: str) -> DataFrame:
    """Stream what is new in ``rows_path`` into the state; (digest, keep, n) of the whole state."""
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER,
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
                "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
                "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
                "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(rows_path)
        keyed = rows.groupBy("digest").agg(F.max(F.struct("id", "file", "row")), F.count(F.lit(1)))
        (keyed.toDF("digest", "keep", "n").writeStream.outputMode("update").format("noop")
         .option("checkpointLocation", state_path).trigger(availableNow=True).start().awaitTermination())
        state = spark.read.format("statestore").load(state_path)
        keep, n = state.schema["value"].dataType.names
        return materialize(state.select(F.col("key.digest").alias("digest"), F.col(f"value.{keep}").alias("keep"),
                                        F.col(f"value.{n}").alias("n")), "dedup-state")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Result:
    """Decisions on every row; see ``deduplicate``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column],
                 state_dir: str | None, call: str | None):
        spark = docs.sparkSession
        self.id_col = id_col
        text = F.coalesce(F.col("doc")[text_col], F.lit(""))
        self.docs = placed(docs).select("doc", F.col("doc")[id_col].alias("id"), text.alias("text"),
                                        digest(text).alias("digest"), "file", "row")
        slim = self.docs.select("digest", "id", "file", "row")
        root = state_dir or shared_path(spark, "dedup")
        folder = f"{root}/rows/{call or uuid.uuid4().hex}"
        # Rows are written once: a finished call is left as it is, and of another only places
        # that no earlier call had are new.
        if not _exists(spark, f"{folder}/_SUCCESS"):
            if _exists(spark, f"{root}/rows"):
                known = spark.read.schema(slim.schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")
                slim = slim.join(known.select("file", "row"), ["file", "row"], "left_anti").select(*slim.columns)
            slim.write.mode("overwrite").parquet(folder)
        self.rows = spark.read.schema(slim.schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")
        self.state = _state(spark, f"{root}/rows", slim.schema, f"{root}/state")
        self.hits = self.state.where("n > 1")
        self.texts = self._all_texts(id_col, text_col, digest) if state_dir else self.docs
        self.odd = self._check_bytes()

    def _all_texts(self, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
        """(digest, id, text, file, row) of this call and of the files that earlier calls read."""
        columns = ["digest", "id", "text", "file", "row"]
        here = self.docs.select(*columns)
        files = [r["file"] for r in self.rows.select("file").distinct().join(
            here.select("file").distinct(), "file", "left_anti").collect()]
        if not files:
            return here
        text = F.coalesce(F.col("doc")[text_col], F.lit(""))
        earlier = placed(here.sparkSession.read.parquet(*files).select(id_col, text_col))
        return here.unionByName(earlier.select(digest(text).alias("digest"), F.col("doc")[id_col].alias("id"),
                                               text.alias("text"), "file", "row"))

    def _check_bytes(self) -> DataFrame | None:
        """Classes by full bytes of digests whose rows are not all equal; None if there are none."""
        of_hits = maybe_among(self.texts.select("digest", "text", "file", "row"), self.hits, ["digest"]).where("__hit").drop("__hit")
        # One text for each hit digest, written, and a join with nothing behind it
        # that needs a digest's rows together: a hot digest can be split.
        stays = materialize(of_hits.join(self.hits.select("digest", "keep"), "digest").where(
            "file = keep.file AND row = keep.row").select("digest", F.col("text").alias("kept")), "dedup-kept")
        differ = of_hits.join(stays, "digest").where(F.col("text") != F.col("kept")).select("digest")
        odd = materialize(differ, "dedup-differ").distinct()
        if odd.isEmpty():
            return None
        return self.texts.join(odd, "digest").groupBy("digest", "text").agg(
            F.max(F.struct("id", "file", "row")).alias("odd_keep"), F.count(F.lit(1)).alias("odd_n"))

    def decisions(self) -> DataFrame:
        """(id, keep_id, group_size, kept, digest) of every row, dropped ones too."""
        out = self.rows.join(self.state, "digest")
        if self.odd is not None:
            places = self.texts.select("digest", "text", "file", "row").join(self.odd, ["digest", "text"])
            out = out.join(places.select("file", "row", "odd_keep", "odd_n"), ["file", "row"], "left").withColumns(
                {"keep": F.coalesce("odd_keep", "keep"), "n": F.coalesce("odd_n", "n")})
        kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        return out.select(F.col("id").alias(self.id_col), F.col("keep.id").alias("keep_id"),
                          F.col("n").alias("group_size"), kept.alias("kept"), "digest")

    def kept(self) -> DataFrame:
        """The input rows that stay, all columns as they were."""
        marked = maybe_among(self.docs, self.hits, ["digest"])
        alone = marked.where(~F.col("__hit")).select("doc.*")
        tried = marked.where("__hit").join(self.hits.select("digest", "keep"), "digest", "left")
        if self.odd is not None:
            tried = tried.join(self.odd, ["digest", "text"], "left").withColumn("keep", F.coalesce("odd_keep", "keep"))
        stays = F.col("keep").isNull() | ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))
        return alone.unionByName(tried.where(stays).select("doc.*"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, state_dir: str | None = None,
                call: str | None = None) -> Result:
    """Find rows of equal text; of each group the row with the largest id stays.

    A null text counts as empty.  A null id comes after all others; of
    repeated rows with one id the last by file and row stays, so exactly one
    row of each group does.  An empty table gives no rows.  Further columns may
    have any name; texts may be of any length, since only digests are held.

    With ``state_dir`` (a shared folder) the state is kept there: a later
    call with more rows continues it, and ``decisions`` covers all rows so
    far.  Rows of files that an earlier call had (by file and row) are not
    counted again, nor is a call with a ``call`` name that was finished; a
    frame that does not come from files needs that name to be known again.
    The Parquet files of earlier calls must still be there, with the same two
    columns; the driver holds their names.  ``digest`` makes a binary key from the
    text; equal bytes decide.
    """
    return Result(docs, id_col, text_col, digest, state_dir, call)
