"""Start-up investment study: header/date repair, funding by year, education
completeness, join-key suitability, splitting the denormalised
company-and-rounds table, candidate filtering, acquisition enrichment and
price statistics.

Inputs: ``s_company_and_rounds`` (one row per company x round; companies
without rounds have null round columns), ``s_acquisition``, ``s_people``,
``s_education``, ``s_fund``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.common import exact_avg, exact_sum, round_half_even, round_half_up, safe_div
from cohortlens.operators.dedup import keep_one
from cohortlens.operators.describe import boxed, described
from cohortlens.operators.ranks import Distribution
from cohortlens.operators.scalar import with_scalars
from cohortlens.sources.tables import normalize_headers

COMPANY_COLS = ("company_ID", "name", "category_code", "status", "founded_at", "closed_at", "domain",
                "network_username", "country_code", "investment_rounds", "funding_rounds", "funding_total",
                "milestones")
ROUND_COLS = ("funding_round_id", "company_id_round", "funded_at", "funding_round_type",
              "raised_amount", "pre_money_valuation", "participants", "is_first_round", "is_last_round")


def parse_date(col: str, fmt: str = "yyyy-MM-dd"):
    """Coercing date parse: malformed text or impossible dates become null."""
    return F.to_date(F.try_to_timestamp(F.col(col).cast("string"), F.lit(fmt)))


def clean_headers_and_dates(df: DataFrame, date_cols: Sequence[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Header runs of two spaces -> ``_``; listed text dates parsed with coercion."""
    x = normalize_headers(df)
    kinds = dict(x.dtypes)
    return x.withColumns({c: parse_date(c, fmt) for c in date_cols if kinds[c] == "string"})


def funding_by_year(cr: DataFrame, min_rounds: int = 50, dp: int = 4) -> DataFrame:
    """Median round size and number of rounds per year (years with more than
    ``min_rounds`` rounds)."""
    x = (cr.select(F.year("funded_at").alias("funded_year"), "raised_amount")
         .where(F.col("raised_amount").isNotNull() & F.col("funded_year").isNotNull()))
    rounds = Distribution.of(x, "raised_amount", ["funded_year"])
    j = rounds.quantiles({"typical_round": .5}, total="rounds_count").where(F.col("rounds_count") > min_rounds)
    return j.select("funded_year", round_half_up("typical_round", dp).alias("typical_round"), "rounds_count")


# --- fixed values: the study's company-size bins [lo, hi) and their labels
SIZE_BINS = ((0, 10, "1-10"), (10, 50, "11-50"), (50, 200, "51-200"), (200, None, "200+"))


def education_gap_by_company_size(people: DataFrame, education: DataFrame, bins=SIZE_BINS,
                                  dedupe_people: bool = False, dp: int = 1) -> DataFrame:
    """Share of staff without education records by company-size bin.

    As in the study, people are left-joined to education before counting, so a
    person with several records counts several times (``dedupe_people=True``
    counts each person once, with education if any record has one).  Bins are
    left-closed ``[lo, hi)`` on the company's row count.
    """
    edu = education.select(F.col("person_id"), F.col("instituition"))
    pe = people.join(edu, people.id == edu.person_id, "left").select(
        "id", "company_id", F.col("instituition").isNotNull().cast("int").alias("has_edu"))
    if dedupe_people:
        pe = pe.groupBy("id", "company_id").agg(F.max("has_edu").alias("has_edu"))
    # Company size = rows per company; bin sums equal the study's join-back.
    per_co = (pe.where(F.col("company_id").isNotNull()).groupBy("company_id")
              .agg(F.count("id").alias("n"), F.sum("has_edu").alias("e")))
    label = F.lit(None).cast("string")
    for lo, hi, name in reversed(bins):
        cond = F.col("n") >= lo if hi is None else (F.col("n") >= lo) & (F.col("n") < hi)
        label = F.when(cond, F.lit(name)).otherwise(label)
    g = (per_co.withColumn("size_group", label).where(F.col("size_group").isNotNull())
         .groupBy("size_group").agg(F.sum("n").alias("t"), F.sum("e").alias("w")))
    spark = people.sparkSession
    grid = spark.createDataFrame([(name, i) for i, (_, _, name) in enumerate(bins)], "size_group string, ord int")
    j = grid.join(g, "size_group", "left")
    t = F.coalesce(F.col("t"), F.lit(0)).cast("long")
    w = F.coalesce(F.col("w"), F.lit(0)).cast("long")
    return j.select("size_group", t.alias("total_employees"), w.alias("employees_with_education"),
                    round_half_even((1.0 - safe_div(w, t)) * 100.0, dp).alias("missing_pct"))


def join_key_suitability(frames: Mapping[str, DataFrame], col: str, dp: int = 1) -> DataFrame:
    """Per dataset: non-null, distinct and null share of a candidate join key."""
    parts = [df.agg(F.lit(name).alias("dataset"), F.count(col).alias("non_null"),
                    F.countDistinct(col).alias("distinct"),
                    round_half_even(F.avg(F.col(col).isNull().cast("double")) * 100.0, dp).alias("null_pct"))
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join_key_overlaps(frames: Mapping[str, DataFrame], col: str) -> DataFrame:
    """Size of the intersection of distinct non-null keys for each pair."""
    names = list(frames)
    keys = {n: frames[n].select(F.col(col).alias("k")).where(F.col("k").isNotNull()) for n in names}
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            common = keys[a].intersect(keys[b])
            parts.append(common.agg(F.lit(f"{a}&{b}").alias("pair"), F.count(F.lit(1)).alias("common")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_companies(cr: DataFrame) -> DataFrame:
    """Company-level columns, one row per company: that of its first round by
    date and id (they repeat on every round row)."""
    c = keep_one(cr.select(*COMPANY_COLS, "funded_at", "funding_round_id"), "company_ID",
                 ["funded_at", "funding_round_id"]).select(*COMPANY_COLS)
    return c.withColumns({"founded_at": parse_date("founded_at"), "closed_at": parse_date("closed_at")})


def split_rounds(cr: DataFrame) -> DataFrame:
    """Round-level columns, one row per round id (that of the least company)."""
    r = cr.select(*ROUND_COLS).where(F.col("funding_round_id").isNotNull())
    return keep_one(r, "funding_round_id", "company_id_round").withColumnRenamed("company_id_round", "company_id")


def normalize_companies_rounds(cr: DataFrame, dp: int = 4) -> DataFrame:
    """Companies with a per-company roll-up of their rounds (left join)."""
    r = split_rounds(cr)
    st = r.groupBy(F.col("company_id").alias("__cid")).agg(
        exact_sum("raised_amount").alias("total_raised"), exact_avg("raised_amount").alias("avg_round_size"),
        F.count("raised_amount").alias("rounds_count"), exact_avg("pre_money_valuation").alias("avg_valuation"),
        F.avg("participants").alias("avg_participants"))
    c = split_companies(cr)
    # Spark resolves names case-insensitively: the round-side key is renamed
    # so it cannot collide with ``company_ID``.
    j = c.join(st, c.company_ID == st["__cid"], "left")
    return j.select("company_ID", "name", "category_code", "status", "founded_at", "closed_at", "domain",
                    "country_code", "investment_rounds", "funding_rounds", "funding_total", "milestones", "rounds_count",
                    round_half_up("total_raised", 2).alias("total_raised"),
                    round_half_up("avg_round_size", dp).alias("avg_round_size"),
                    round_half_up("avg_valuation", dp).alias("avg_valuation"),
                    round_half_up("avg_participants", dp).alias("avg_participants"))


def candidate_companies(companies: DataFrame) -> DataFrame:
    """Companies that raised rounds, invested, or were acquired."""
    cond = ((F.coalesce(F.col("funding_rounds") > 0, F.lit(False)))
            | (F.coalesce(F.col("investment_rounds") > 0, F.lit(False)))
            | (F.coalesce(F.col("status") == "acquired", F.lit(False))))
    return companies.where(cond)


def status_shares(companies: DataFrame, dp: int = 1) -> DataFrame:
    g = companies.where(F.col("status").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return g.select("status", round_half_even(
        safe_div(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy())), dp).alias("pct"))


def missing_stats(df: DataFrame, dp: int = 2) -> DataFrame:
    """Columns with missing values: count and share of rows."""
    rows = F.count(F.lit(1))
    agg = df.agg(rows.alias("__rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    long = agg.select("__rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])).alias("kv"))
    return (long.select("kv.column", "kv.missing", "__rows").where(F.col("missing") > 0)
            .select("column", "missing", round_half_even(safe_div(F.col("missing") * 100.0, "__rows"), dp)
                    .alias("missing_pct")))


FINAL_COLS = ("company_ID", "name", "category_code", "status", "founded_at", "closed_at", "domain",
              "country_code", "milestones", "funding_rounds", "investment_rounds", "funding_total", "rounds_count", "total_raised", "avg_round_size")


def acquisition_enrichment(companies: DataFrame, acquisition: DataFrame) -> DataFrame:
    """Adds ``was_acquired`` (id present in deals) and the first deal date."""
    first = (acquisition.groupBy("acquired_company_id")
             .agg(F.min("acquired_at").alias("acquisition_date")))
    c = companies.select(*FINAL_COLS)
    j = c.join(first, c.company_ID == first.acquired_company_id, "left")
    return j.select(F.col("company_ID").alias("company_id"), *FINAL_COLS[1:],
                    F.col("acquired_company_id").isNotNull().alias("was_acquired"), "acquisition_date")


def status_consistency(final: DataFrame) -> DataFrame:
    acq = F.coalesce(F.col("status") == "acquired", F.lit(False))
    return final.agg(
        F.count(F.when(acq & F.col("acquisition_date").isNull(), 1)).alias("acquired_no_date"),
        F.count(F.when(~acq & F.col("acquisition_date").isNotNull(), 1)).alias("date_not_acquired"))


def funding_summary(final: DataFrame) -> DataFrame:
    """describe() of total funding plus box numbers of the positive part, from one table of value counts."""
    funding = Distribution.of(final, "funding_total")
    d = described(funding)
    b = boxed(funding.where(F.col("__v") > 0))
    b = b.select(*[F.col(c).alias(f"box_{c}") for c in ("q1", "median", "q3")], "whisker_low",
                 "whisker_high", "fliers")
    return with_scalars(d, b)


def _deals(final: DataFrame, acquisition: DataFrame) -> DataFrame:
    a = acquisition.select("acquired_company_id", "acquiring_company_id", "price_amount", "acquired_at")
    return final.join(a, final.company_id == a.acquired_company_id)


def symbolic_sales(final: DataFrame, acquisition: DataFrame, prices: Sequence[float] = (0, 1)) -> DataFrame:
    """Funded companies sold for a symbolic price."""
    j = _deals(final, acquisition)
    return (j.where(F.col("price_amount").isin(*prices) & (F.col("funding_total") > 0))
            .select("company_id", "name", "status", "funding_total", "price_amount",
                    "acquiring_company_id", F.col("acquired_at")))


def category_price_stats(final: DataFrame, acquisition: DataFrame, min_count: int = 10,
                         order_by: str = "median_price", k: int = 10, dp: int = 4) -> DataFrame:
    """Seven price statistics per category (n >= ``min_count``), top ``k``."""
    j = _deals(final, acquisition).where(F.col("category_code").isNotNull())
    prices = Distribution.of(j, "price_amount", ["category_code"])
    q = prices.quantiles({"q1": .25, "median_price": .5, "q3": .75})
    s = prices.moments().withColumnsRenamed({c: f"{c}_price" for c in ("mean", "std", "min", "max")})
    s = s.where(F.col("count") >= min_count).join(q, "category_code", "left")
    s = s.select("category_code", "count", round_half_up("median_price", dp).alias("median_price"),
                 round_half_up("mean_price", dp).alias("mean_price"),
                 round_half_up("std_price", dp).alias("std_price"),
                 "min_price", "max_price",
                 round_half_up(F.col("q3") - F.col("q1"), dp).alias("iqr_price"))
    return s.orderBy(F.col(order_by).desc_nulls_last(), "category_code").limit(k)


def rounds_by_status(final: DataFrame, dp: int = 4) -> DataFrame:
    x = final.where(F.col("status").isNotNull())
    rounds = Distribution.of(x, "funding_rounds", ["status"])
    j = rounds.moments().join(rounds.quantiles({"median": .5}), "status", "left")
    return j.select("status", round_half_up("median", dp).alias("median"),
                    round_half_up("mean", dp).alias("mean"), "count")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values (a small set by construction)."""
    return df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")

