"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a rate per thousand of the text; a document is rejected when a
rate reaches the cutoff of its stratum (its language).  Cutoffs come from
labelled documents, none of which was used to make the rules.  For a stratum
with n good documents, a cutoff that rejects k of them is certified when

    P(Binomial(n, alpha / rules) <= k)  <=  delta / (strata * rules)

that is, when the exact (Clopper-Pearson) upper bound of its false-rejection
rate is at most ``alpha / rules``.  Bonferroni over strata and rules is the
multiple-testing correction; within one rule and stratum the tests form a
fixed sequence from the mildest cutoff on, which needs none.  So with
probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good
documents to all rules together.  Among the certified cutoffs the one with
the best (bad rejected - ``weight`` * good rejected) is taken, if positive;
a stratum with too few labels, or none, has no cutoff and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
# numerator and denominator of each rule's rate
RATES = {"symbols": ("n_symbols", "word_chars"), "repeated_words": ("n_repeat_words", "n_words"),
         "repeated_lines": ("n_dup_lines", "n_lines"), "capitals": ("n_capitals", "word_chars"),
         "exclamations": ("n_exclamations", "n_words")}
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
        "n_exclamations", "base_failed"]
MAX_STRATA = 10_000


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``MADE``; a null text has no words.

    Columns of ``docs`` with those names are replaced, others may have any name.
    An empty text has no words either.  Texts may be of any length: one is
    measured in its row, in time and memory linear in it but for sorting its
    windows where some repeat.
    """
    kept = [c for c in docs.columns if c not in MADE]
    if text_col not in kept:
        raise ValueError(f"the text column can't be named {text_col}")
    text = F.col("__t")
    # The caller's columns in one struct: no name of theirs can meet one used here.
    out = docs.select(F.struct(*kept).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    out = out.select("__doc", "__t", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__w"),
                     F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "").alias("__l"))
    out = out.select(
        "__doc", "__w", F.size("__w").cast("long").alias("n_words"),
        _without(text, SPACES).cast("long").alias("word_chars"),
        (F.char_length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.char_length(text) - _without(text, CAPITALS)).cast("long").alias("n_capitals"),
        (F.char_length(text) - _without(text, "!")).cast("long").alias("n_exclamations"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    # Windows by hash: equal windows have equal hashes, so texts in which all
    # hashes differ (nearly all) repeat none.
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")))
    out = out.withColumn("__i", F.coalesce(starts, F.array().cast("array<int>")))
    out = out.withColumn("__x", F.transform("__i", lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)])))
    out = out.withColumn("__r", F.size(F.array_distinct("__x")) < F.size("__x"))
    # The others compare the windows' words themselves, sorted side by side.
    windows = F.transform("__i", lambda i: F.struct(
        F.array_join(F.slice("__w", i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("i")))
    out = out.withColumn("__s", F.when(F.col("__r"), F.array_sort(windows)))
    twice = F.filter("__s", lambda x, k: F.coalesce(x["w"] == F.get("__s", k - 1)["w"], F.lit(False))
                     | F.coalesce(x["w"] == F.get("__s", k + 1)["w"], F.lit(False)))
    out = out.withColumn("__p", F.when(F.col("__r"), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    # Words covered by windows that start at these positions.
    covered = F.aggregate("__p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(WINDOW))).alias("n")),
                          lambda a: a["n"])
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__r"), covered), F.lit(0).cast("long")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # One struct through explode: a filter on the results stays above it and
    # doesn't copy the nested expressions into itself.
    made = F.explode(F.array(F.struct(*MADE[:-1], failed.alias("base_failed"))))
    return out.select("__doc", made.alias("__made")).select("__doc.*", "__made.*")


def rates() -> Column:
    """(rule, rate) structs: thousandths, at most 1000; 0 where there is nothing to count."""
    return F.array(*[F.struct(F.lit(rule).alias("rule"), F.coalesce(F.least(F.try_divide(
        1000 * F.col(num), F.col(den)).cast("int"), F.lit(1000)), F.lit(0)).alias("rate"))
        for rule, (num, den) in RATES.items()])


def thresholds(measured: DataFrame, labels: DataFrame, stratum: Column, id_col: str = "doc_id",
               label_col: str = "quality", alpha: float = 0.02, delta: float = 0.05, weight: float = 20.0) -> DataFrame:
    """(stratum, rule, reject_from, n_good, good_rejected, bad_rejected) of the chosen cutoffs.

    ``labels`` has the id and 1 for good, 0 for bad; a null id or label is
    left out, and of several labels of one id the least counts.  Documents
    that fail the base rules take no part.
    """
    truth = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__good"))
    seen = measured.where(~F.col("base_failed")).select(id_col, stratum.alias("stratum"), F.explode(rates()).alias("r")).join(
        truth, id_col)
    seen = seen.groupBy("stratum", "r.rule", "r.rate").agg(
        F.sum(F.when(F.col("__good") == 1, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("__good") == 0, 1).otherwise(0)).alias("bad"))
    # One row for each stratum, rule and rate from here on: at most 1001 a group.
    group = Window.partitionBy("stratum", "rule")
    above = group.orderBy(F.desc("rate")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumns({"n_good": F.sum("good").over(group), "good_rejected": F.sum("good").over(above),
                             "bad_rejected": F.sum("bad").over(above)})
    seen = materialize(seen, "quality-counts")
    sizes = seen.groupBy("stratum").agg(F.max("n_good").alias("n_good"))
    tests = sizes.select((F.count(F.lit(1)) * len(RATES)).alias("m"))
    m = F.lit(max(tests.first()["m"], 1))
    limit = sizes.select("stratum", _most(F.col("n_good"), alpha / len(RATES), F.log(F.lit(delta) / m)).alias("most"))
    gain = F.col("bad_rejected") - weight * F.col("good_rejected")
    sure = seen.join(limit, "stratum").where((F.col("rate") > 0) & (F.col("good_rejected") <= F.col("most")) & (gain > 0))
    best = F.max(F.struct(gain.alias("gain"), F.col("rate").alias("reject_from"), "n_good", "good_rejected", "bad_rejected"))
    return sure.groupBy("stratum", "rule").agg(best.alias("b")).select(
        "stratum", "rule", "b.reject_from", "b.n_good", "b.good_rejected", "b.bad_rejected")


def _most(n: Column, p: float, log_level: Column) -> Column:
    """Largest k with log P(Binomial(n, p) <= k) <= log_level, or -1 (below the mean, where it lies)."""
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.lit(float("-inf")).alias("total"), F.lit(-1).cast("long").alias("k"))

    def step(a, j):
        more = a["term"] + F.log1p(F.exp(a["total"] - a["term"]))  # log(e^total + e^term)
        return F.struct((a["term"] + F.log((n - j) / (j + 1) * odds)).alias("term"), more.alias("total"),
                        F.when(more <= log_level, j).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * p).cast("long")), start, step, lambda a: a["k"])


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """``measured`` with ``rejected_by`` (rules, empty if none) and ``kept``, which replace columns of these names.

    Every row gets a decision of its own, repeated ones and those with a null
    id too; a stratum without a cutoff rejects nothing.
    """
    chosen = materialize(cutoffs.groupBy(F.col("stratum").alias("__stratum")).agg(F.map_from_entries(
        F.collect_list(F.struct("rule", "reject_from"))).alias("__cut")), "quality-cutoffs")
    if chosen.count() <= MAX_STRATA:  # a row of a few numbers for each stratum
        chosen = F.broadcast(chosen)
    kept = [c for c in measured.columns if c not in ("rejected_by", "kept")]
    rows = measured.select(F.struct(*kept).alias("row"), stratum.alias("__stratum"), rates().alias("rates"), "base_failed")
    by = F.transform(F.filter("rates", lambda r: r["rate"] >= F.coalesce(
        F.try_element_at("__cut", r["rule"]), F.lit(1001))), lambda r: r["rule"])
    joined = rows.join(chosen, "__stratum", "left").select("row", "base_failed", by.alias("by"))
    passed = ~F.col("base_failed") & (F.size("by") == 0)
    return joined.select("row.*", F.col("by").alias("rejected_by"), passed.alias("kept"))


def language(lang_col: str = "lang") -> Column:
    return F.coalesce(F.col(lang_col), F.lit("und"))
