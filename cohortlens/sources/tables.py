"""Table access: parquet scans, schema-on-read CSV, header normalisation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from cohortlens.session import written

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Tables:
    """Lazy accessor for the parquet tables of one data directory.

    ``Tables(spark, d).orders`` is a plain ``spark.read.parquet`` scan, so
    Catalyst prunes columns and pushes filters into the Parquet reader.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DRIVER_TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.base}/{name}.parquet")
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, *,
             index_col: str | None = None, timestamp_format: str | None = None,
             date_format: str | None = None) -> DataFrame:
    """CSV scan with an explicit schema (never ``inferSchema`` at scale).

    ``index_col`` names the first, unnamed column of a pandas-written CSV
    (``index_col=0``): it is kept as an ordinary column and gives
    order-dependent operators (keep first/last) an explicit row order.
    gzip/bz2 inputs are read natively, zip archives by ``sources.zipped``;
    ``read_csv_in_order`` numbers the rows of files without such a column.
    """
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format)
    if date_format:
        r = r.option("dateFormat", date_format)
    df = r.schema(schema).csv(path)
    if index_col and df.columns and df.columns[0] != index_col:
        df = df.withColumnRenamed(df.columns[0], index_col)
    return df


def read_csv_in_order(spark: SparkSession, path: str, schema: StructType | str, *, index_col: str = "row_idx",
                      sep: str = ",", header: bool = True) -> DataFrame:
    """CSV rows after ``index_col``, their number (from 0) in file order: files by name, then lines.

    Files are split as any text is.  One job writes the lines with their split
    and their order in it; the lines of each split are counted, prefix sums
    over the splits (one row a split) give the number of its first line, and a
    line's own number follows.  So order-dependent operators need no column of
    the caller's, and no task reads a whole file.  A record is one line; text
    that does not fit the schema becomes null; empty lines don't count; with
    ``header`` the first line of each file is left out.
    """
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    # Ids are consecutive within a split, whose lines stand together in a partition.
    lines = written(spark.read.text(path).where("value != ''").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at")), "csv-lines")
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    in_file = Window.partitionBy("file").orderBy("start")
    splits = splits.withColumn("head", (F.row_number().over(in_file) == 1).cast("long") if header else F.lit(0))
    before = F.sum(F.col("n") - F.col("head")).over(Window.orderBy("file", "start"))
    splits = splits.select("file", "start", "first", "head", (before - F.col("n")).alias("before"))
    placed = lines.join(splits, ["file", "start"]).withColumn("place", F.col("at") - F.col("first"))
    rows = placed.where((F.col("head") == 0) | (F.col("place") > 0)).select(
        (F.col("before") + F.col("place")).alias(index_col), F.from_csv("value", kind, {"sep": sep}).alias("r"))
    return rows.select(index_col, "r.*")


def normalize_headers(df: DataFrame, pattern: str = " {2}", repl: str = "_") -> DataFrame:
    """Rename columns whose header uses runs of spaces as separators.

    A header such as ``funding  round  id`` becomes ``funding_round_id``.
    Pure metadata: no data is touched.
    """
    return df.toDF(*[re.sub(pattern, repl, c.strip()) for c in df.columns])
