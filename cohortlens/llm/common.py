"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.session import ensure_checkpoint_dir

# White_Space of the Unicode database, which `\s` of the tokenizers' regular
# expressions means (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

BITMAP_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: the files survive the loss of any executor, and every
    later reader sees the same rows.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame) -> DataFrame:
    """(doc, file, row): the rows of ``docs`` as structs with the place of each row's content.

    Rows that don't come straight from files are written to the shared folder first.
    """
    place = [F.struct(*docs.columns).alias("doc"), F.col("_metadata.file_path").alias("file"),
             F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*place)
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
    return materialize(docs, "located").select(*place)


def maybe_among(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` plus ``__hit``, which is false only where the keys are not among those of ``listed``.

    A one-hash Bloom filter: ``listed`` sets bits in a bitmap of ``BITMAP_BITS``
    bits, which is broadcast (1,024 rows of 4 KB, whatever the input), so the
    rest of ``rows`` can skip the shuffle of an exact join.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS)) + F.lit(1)
    bitmap = listed.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    joined = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmap), "__bucket", "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    value = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn("__hit", F.coalesce(value, F.lit(False))).drop("__bucket", "__bits")


def without_rows(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of ``rows`` (from ``placed``) less those whose ``file`` and ``row`` are in ``dropped``.

    Only rows that may be dropped are shuffled.
    """
    marked = maybe_among(rows, dropped, ["file", "row"])
    stay = marked.where("__hit").join(dropped.select("file", "row"), ["file", "row"], "left_anti")
    return marked.where(~F.col("__hit")).select("doc.*").unionByName(stay.select("doc.*"))


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def text_slices(batches: Iterable[pa.RecordBatch], text_col: str,
                max_chars: int = 2_000_000, max_rows: int = 2_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut into slices of about ``max_chars`` characters.

    A text longer than that makes a slice of its own; a null text is empty.
    No more than a slice of a batch's texts are Python strings at a time.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            fit = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + max_chars, "right"))
            last = min(max(fit, first + 1), first + max_rows)
            part = batch.slice(first, last - first)
            yield part, [t or "" for t in column.slice(first, last - first).to_pylist()]
            first = last
