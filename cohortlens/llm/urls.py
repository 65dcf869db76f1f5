"""URL rules: a blocked Bloom filter in front of an exact hash join.

A listed entry is a canonical (host, path prefix).  A url can only match
entries whose host is its own host or a parent of it and whose path is one of
the url path's prefixes with a listed length, so each distinct (host, path
head) gives a handful of candidate keys.  A candidate looks up one block of
the Bloom filter (an equi-join on the block's number) and passes when all its
bits are set there; what passes is joined with the list by (host, path),
which removes the filter's false positives.  All of it is DataFrame code, and
filter and list may be of any size: the planner broadcasts them only below its
own threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

WORDS = 8  # 64-bit words in a block: one bit of each is set for a key
KEYS_PER_BLOCK = 32  # 16 bits a key


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, ASCII letters lower-cased) and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _bits(host: Column, path: Column, blocks: Column) -> tuple[Column, Column]:
    """Block of a key and its mask: one bit in each of the block's words."""
    h = F.xxhash64(host, path)
    g = F.xxhash64(path, host, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 6 * w).bitwiseAND(F.lit(63)).cast("int"))
             for w in range(WORDS)]
    return F.pmod(h, blocks), F.array(*masks)


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the blocked Bloom filter of ``listed`` (host, path)."""
    block, masks = _bits(F.col("host"), F.col("path"), F.lit(blocks).cast("long"))
    keys = listed.select(block.alias("block"), masks.alias("m"))
    return keys.groupBy("block").agg(*[F.bit_or(F.col("m")[w]).alias(f"w{w}") for w in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``listed`` has ``host``, ``path`` and ``verdict``.  An entry fits its host
    and all subdomains where the url's path starts with its path; the entry
    with the longest host plus path wins, then the longest host.  A url that
    no entry fits is not listed: rule null, verdict ``default``.  A null url
    and one without ``://`` have empty host and path, which fit no entry.
    An entry listed twice counts once (the verdict ``block`` before
    ``allow``).  Columns of ``pages`` with the names of the four are replaced,
    others may have any name.  Urls may be of any length: of a host only the
    last labels, as many as the longest listed host has, are tried, and of a
    path only a head as long as the longest listed one.
    """
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).where("host != ''")
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths"),
                      F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    lengths = sorted(size["lengths"])
    host, path = split_url(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if url_col not in kept:
        raise ValueError(f"the url column can't be named {url_col}")
    # The caller's columns in one struct: no name of theirs can meet one used here.
    parsed = pages.select(F.struct(*kept).alias("page"), host.alias("host"), path.alias("path"))
    if not lengths:
        return parsed.select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"),
                             F.lit(default).alias("verdict"))
    # Only the path's first characters can matter: few distinct rows are left.
    parsed = parsed.withColumn("__head", F.substring("path", 1, max(lengths)))
    heads = parsed.where("host != ''").select("host", "__head").distinct()
    parents = F.transform(F.sequence(F.lit(1), F.lit(size["labels"])),
                          lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    tries = heads.select("host", "__head", F.explode(F.array_distinct(parents)).alias("__host")).select(
        "*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("__n")).where(F.length("__head") >= F.col("__n"))
    tries = tries.select("host", "__head", "__host", F.expr("substring(__head, 1, __n)").alias("__path"))
    # Possible hits: all bits of the key are set in its block.
    count = max(1, -(-size["n"] // KEYS_PER_BLOCK))
    block, masks = _bits(F.col("__host"), F.col("__path"), F.lit(count).cast("long"))
    tries = tries.withColumns({"block": block, "__m": masks})
    passes = F.lit(True)
    for w in range(WORDS):
        passes = passes & (F.col(f"w{w}").bitwiseAND(F.col("__m")[w]) == F.col("__m")[w])
    possible = tries.join(bloom_blocks(listed, count), "block").where(passes).select("host", "__head", "__host", "__path")
    # Exact join, then the longest entry of each (host, path head).
    exact = listed.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("verdict").alias("__v"))
    best = possible.join(exact, ["__host", "__path"]).groupBy("host", "__head").agg(
        F.max(F.struct((F.length("__host") + F.length("__path")).alias("n"), F.length("__host").alias("m"),
                       F.concat("__host", "__path").alias("rule"), F.col("__v").alias("verdict"))).alias("__b"))
    # Written, so that the join has a shuffle on both sides and a hot host can be split.
    best = materialize(best, "url-rules")
    return parsed.join(best, ["host", "__head"], "left").select(
        "page.*", "host", "path", F.col("__b.rule").alias("rule"),
        F.coalesce(F.col("__b.verdict"), F.lit(default)).alias("verdict"))


def rules(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """A list given in code: (host, path, verdict) rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
                               for h, p, v in entries]))
    return spark.range(1).select(rows.alias("r")).select("r.*")
