"""Queries of the text operators: ``(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, conversations, dedup, jaccard, langid, packing, quality, secret_scan, sharding, spelling, token_counts,
               toxicity, urls)
from .common import crc_remainder, materialize, table

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "cut")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = materialize(quality.measure(docs).drop("text"), "quality")
    cutoffs = quality.thresholds(measured, table(spark, sf_dir, "labels"), quality.language())
    return quality.judge(measured, cutoffs, quality.language()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text FROM documents),
cut_up AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (
  SELECT k, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM cut_up WHERE len(words) >= 8)),
twice AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, w) > 1),
covered AS (
  SELECT k, sum(least(step, 8)) AS n_repeat_words
  FROM (SELECT k, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i), 8) AS step FROM twice) GROUP BY k),
counted AS (
  SELECT k, doc_id, stratum, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
         length(text) - length(translate(text, '!', '')) AS n_exclamations,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM cut_up LEFT JOIN covered USING (k)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
rated AS (
  SELECT k, doc_id, stratum, base_failed, unnest([
    {'rule': 'symbols', 'rate': coalesce(1000 * n_symbols // nullif(word_chars, 0), 0)},
    {'rule': 'repeated_words', 'rate': coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)},
    {'rule': 'repeated_lines', 'rate': coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0)},
    {'rule': 'capitals', 'rate': coalesce(1000 * n_capitals // nullif(word_chars, 0), 0)},
    {'rule': 'exclamations', 'rate': coalesce(1000 * n_exclamations // nullif(n_words, 0), 0)}], recursive := true)
  FROM based),
capped AS (SELECT k, doc_id, stratum, base_failed, rule, least(rate, 1000) AS rate FROM rated),
truth AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
tallied AS (
  SELECT stratum, rule, rate, count(*) FILTER (good = 1) AS good, count(*) FILTER (good = 0) AS bad
  FROM capped JOIN truth USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
summed AS (
  SELECT stratum, rule, rate, sum(good) OVER (PARTITION BY stratum, rule) AS n_good,
         sum(good) OVER (PARTITION BY stratum, rule ORDER BY rate DESC) AS good_rejected,
         sum(bad) OVER (PARTITION BY stratum, rule ORDER BY rate DESC) AS bad_rejected FROM tallied),
sizes AS (SELECT stratum, max(n_good)::BIGINT AS n FROM summed GROUP BY stratum),
tests AS (SELECT count(*) * 5 AS m FROM sizes),
tails AS (
  SELECT stratum, j, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.004) + (n - j) * ln(0.996)))
           OVER (PARTITION BY stratum ORDER BY j) AS p
  FROM (SELECT stratum, n, unnest(range(0, floor(n * 0.004)::BIGINT + 1)) AS j FROM sizes)),
limits AS (SELECT stratum, max(j) AS most FROM tails, tests WHERE p <= 0.05 / m GROUP BY stratum),
cutoffs AS (
  SELECT stratum, rule, rate AS reject_from FROM summed JOIN limits USING (stratum)
  WHERE rate > 0 AND good_rejected <= most AND bad_rejected - 20 * good_rejected > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad_rejected - 20 * good_rejected DESC, rate DESC) = 1),
rejected AS (SELECT DISTINCT k FROM capped JOIN cutoffs USING (stratum, rule) WHERE rate >= reject_from)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND k NOT IN (SELECT k FROM rejected) AS kept
FROM based
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder("doc_id", 4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "offending")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder("doc_id", 5) == 0
    model = langid.train(docs, ~held_out, public_tokenizers.path(PIECES))
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8).withColumn("grown_shard", F.lit(None).cast("int"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rules(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, rest, length(regexp_extract(rest, '^[^/?#]*')) AS n FROM parts),
named AS (
  SELECT page_id, translate(left(rest, n), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, n + 1), '^[^?#]*') AS path FROM split),
numbered AS (SELECT *, row_number() OVER () AS k FROM named),
hits AS (
  SELECT k, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC) AS place
  FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM hits WHERE place = 1) USING (k)
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.deduplicate(table(spark, sf_dir, "documents")).decisions()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    secrets = F.col("secrets")
    base = secret_scan.of_kinds(secrets, *secret_scan.BASE_KINDS)
    counts = [F.size(secret_scan.of_kinds(secrets, k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(secrets).alias("spans"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
    return repaired.withColumnRenamed("conv", "conv_id")


# crc32 of a string below U+0800: its bytes folded through the table of the reflected polynomial.
CRC_TABLE = """
bits(k, c, step) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE step = 8)"""


def crc32_sql(text: str) -> str:
    codes = (f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] "
             "ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))")
    return (f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)")


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT *, {crc32_sql('k')} % 20 AS f FROM keyed, crc_table),
damaged AS (
  SELECT g, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) copies(copy) WHERE f <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending FROM damaged),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         coalesce(lag(initial) OVER (PARTITION BY g ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM ordered),
faults AS (
  SELECT *, ending = '' AS blank, ending <> '' AND again AS duplicate,
         ending <> '' AND NOT again AND ending NOT IN ('.', '!', '?') AS truncated FROM marked),
sizes AS (SELECT g, count(*) AS n FROM faults GROUP BY g),
-- Cheapest edits of the last rows by state (nothing yet, after s, after u, after a), ties by the audit.
steps(g, i, v) AS (
  SELECT g, n, [{{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}] FROM sizes UNION ALL
  SELECT g, i - 1, [list_min([r[q], {{'c': 2 + y[nx[q]].c, 'a': 'I' || y[nx[q]].a}}]) FOR q IN [1, 2, 3, 4]]
  FROM (
    SELECT *, [list_min([r[q], {{'c': 2 + x[nx[q]].c, 'a': 'I' || x[nx[q]].a}}]) FOR q IN [1, 2, 3, 4]] AS y
    FROM (
      SELECT *, [list_min([r[q], {{'c': 2 + r[nx[q]].c, 'a': 'I' || r[nx[q]].a}}]) FOR q IN [1, 2, 3, 4]] AS x
      FROM (
        SELECT *, [list_min([
            {{'c': 3 + v[q].c, 'a': 'D' || v[q].a}},
            {{'c': CASE WHEN to_keep[q] > 0 THEN cut + v[to_keep[q]].c ELSE 1000000000 END,
             'a': 'K' || CASE WHEN to_keep[q] > 0 THEN v[to_keep[q]].a ELSE '' END}},
            {{'c': must + 2 + cut + v[nx[q]].c, 'a': 'R' || v[nx[q]].a}}]) FOR q IN [1, 2, 3, 4]] AS r
        FROM (
          SELECT s.g, s.i, s.v, [3, 3, 4, 3] AS nx, truncated::INT AS cut,
                 CASE WHEN blank OR duplicate THEN 1000000000 ELSE 0 END AS must,
                 CASE WHEN blank OR duplicate THEN [0, 0, 0, 0] WHEN initial = 's' THEN [2, 0, 0, 0]
                      WHEN initial = 'u' THEN [3, 3, 0, 3] WHEN initial = 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS to_keep
          FROM steps s JOIN faults f ON s.g = f.g AND s.i = f.i))))),
audits AS (SELECT g, v[1].c AS cost, v[1].a AS audit FROM steps WHERE i = 0),
edits AS (
  SELECT g, k, substr(audit, k, 1) AS e, length(replace(left(audit, k), 'I', '')) AS i,
         length(replace(left(audit, k), 'D', '')) AS place
  FROM audits, range(1, length(audit) + 1) p(k)),
kept AS (
  SELECT e.*, f.role, f.text, bool_or(e.place = 1 AND e.e = 'K' AND f.initial = 's') OVER (PARTITION BY e.g) AS led
  FROM edits e LEFT JOIN faults f ON e.g = f.g AND e.i = f.i AND e.e <> 'I' WHERE e.e <> 'D'),
repaired AS (
  SELECT g, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place + led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                              || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS h FROM kept GROUP BY g),
figures AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (illegal) AS illegal FROM faults GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM keyed) LEFT JOIN figures USING (g) LEFT JOIN audits USING (g) LEFT JOIN repaired USING (g)
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), misspell=199))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{6,}}')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
keyed AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS k, count(*) AS n FROM found GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql('k')} AS h FROM keyed, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
dels AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM words, range(0, length(word)) p(i)),
pairs AS (
  SELECT a.word, b.word AS near FROM dels a JOIN dels b ON a.i = b.i AND a.d = b.d AND a.word <> b.word UNION
  SELECT a.word, b.word FROM dels a JOIN words b ON a.d = b.word UNION
  SELECT b.word, a.word FROM dels a JOIN words b ON a.d = b.word),
ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
  FROM pairs p JOIN words w ON w.word = p.near),
forms AS (SELECT r.word, near AS form, near_n FROM ranked r JOIN words w ON w.word = r.word WHERE place = 1 AND near_n >= 5 * w.n),
chains(word, link, depth) AS (
  SELECT word, word, 0 FROM words UNION ALL SELECT c.word, f.form, depth + 1 FROM chains c JOIN forms f ON f.word = c.link),
roots AS (SELECT word, arg_max(link, depth) AS root FROM chains GROUP BY word)
SELECT w.word, f.form, root, w.n, coalesce(r.n_near, 0) AS n_near, f.near_n AS form_n
FROM words w JOIN roots USING (word) LEFT JOIN forms f ON f.word = w.word LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
"""


QUERIES = {
    "op1_packing": op1_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_urls": op9_urls,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_secrets": op11_secrets,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {
    "op3_quality": OP3_SQL,
    "op9_urls": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_conversations": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
