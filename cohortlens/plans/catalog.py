"""Query catalog: binds every composite operator to the adapter views and the
fixture parameters.  ``QUERIES[name](spark, data_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators.assoc import strongest_correlate
from cohortlens.operators.describe import density_histogram, describe as _describe, iqr_bounds as _iqr
from cohortlens.operators.profile import profile
from cohortlens.plans import books, cohort as C, delivery, game as G, places as P, realty
from cohortlens.plans import sessions as S, startups as SU, talks as K
from cohortlens.session import scratch
from cohortlens.sources import adapters as A
from cohortlens.sources.tables import Tables, read_csv, read_csv_in_order
from cohortlens.sources.zipped import read_zipped_csv, write_zipped_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------- delivery
CITY = "ASIA"
EV_WINDOW = ("2024-01-01", "2024-02-29")
COHORT_WINDOW = ("2024-01-01", "2024-02-23")
SALES_WINDOW = ("1996-01-01", "1996-06-30")


@query("dau")
def _dau(spark, d):
    t = Tables(spark, d)
    return delivery.dau(A.d_events(t), A.d_cities(t), CITY, *EV_WINDOW)


@query("conversion_rate")
def _cr(spark, d):
    t = Tables(spark, d)
    return delivery.conversion_rate(A.d_events(t), A.d_cities(t), CITY, *EV_WINDOW)


@query("avg_check_monthly")
def _avg_check(spark, d):
    t = Tables(spark, d)
    return delivery.avg_check_monthly(A.d_sales(t), A.d_cities(t), CITY, *SALES_WINDOW)


@query("ltv_top_restaurants")
def _ltv_rest(spark, d):
    t = Tables(spark, d)
    return delivery.ltv_top_restaurants(A.d_sales(t), A.d_cities(t), A.d_partners(t), CITY,
                                        *SALES_WINDOW)


@query("ltv_top_dishes")
def _ltv_dishes(spark, d):
    t = Tables(spark, d)
    return delivery.ltv_top_dishes(A.d_sales(t), A.d_cities(t), A.d_partners(t), A.d_dishes(t),
                                   CITY, *SALES_WINDOW)


@query("retention_daily")
def _ret_daily(spark, d):
    t = Tables(spark, d)
    return delivery.retention_daily(A.d_events(t), A.d_cities(t), CITY, COHORT_WINDOW, EV_WINDOW)


@query("retention_by_month")
def _ret_month(spark, d):
    t = Tables(spark, d)
    return delivery.retention_by_month(A.d_events(t), A.d_cities(t), CITY, COHORT_WINDOW, EV_WINDOW)


# ------------------------------------------------------------- books

BOOK_MONTH = 1
BOOK_COHORT_DAY = "2024-01-02"
BOOK_CITIES = ("ASIA", "EUROPE")
BOOK_PRICE = 399
BOOK_WINDOW = ("2024-01-01", "2024-04-01")


@query("mau_authors")
def _mau_authors(spark, d):
    t = Tables(spark, d)
    return books.mau_authors(A.b_audition(t), A.b_content(t), A.b_author(t), month=BOOK_MONTH)


@query("mau_content")
def _mau_content(spark, d):
    t = Tables(spark, d)
    return books.mau_content(A.b_audition(t), A.b_content(t), A.b_author(t), month=BOOK_MONTH)


@query("retention_fixed_cohort")
def _ret_fixed(spark, d):
    t = Tables(spark, d)
    return books.retention_fixed_cohort(A.b_audition(t), BOOK_COHORT_DAY)


@query("ltv_subscription")
def _ltv_sub(spark, d):
    t = Tables(spark, d)
    return books.ltv_subscription(A.b_audition(t), A.b_geo(t), BOOK_CITIES, BOOK_PRICE)


@query("avg_hour_revenue")
def _avg_hour(spark, d):
    t = Tables(spark, d)
    return books.avg_hour_revenue(A.b_audition(t), *BOOK_WINDOW, price=BOOK_PRICE)


@query("user_hours_by_city")
def _user_hours(spark, d):
    t = Tables(spark, d)
    return books.user_hours_by_city(A.b_audition(t), A.b_geo(t), BOOK_CITIES)


# ------------------------------------------------------------- realty

CAPITAL = "NATION_0"
PARTIAL_YEARS = (1995, 2001)
MIN_ADS = 350


@query("trim_outliers")
def _trim(spark, d):
    return realty.trim_flats(A.r_flats(Tables(spark, d)))


@query("exposure_segments")
def _exposure(spark, d):
    t = Tables(spark, d)
    return realty.exposure_segments(A.r_flats(t), A.r_advertisement(t), A.r_city(t), CAPITAL,
                                    PARTIAL_YEARS)


@query("listing_seasonality")
def _season(spark, d):
    t = Tables(spark, d)
    return realty.listing_seasonality(A.r_flats(t), A.r_advertisement(t))


def _market(spark, d):
    t = Tables(spark, d)
    return realty.settlement_market(A.r_flats(t), A.r_advertisement(t), A.r_city(t), CAPITAL,
                                    PARTIAL_YEARS, MIN_ADS)


query("settlement_market")(_market)


@query("settlement_rankings")
def _rankings(spark, d):
    return realty.settlement_rankings(_market(spark, d), k=5)


@query("settlement_rankings__price_ratio")
def _ratio(spark, d):
    return realty.settlement_price_ratio(_market(spark, d))


# ------------------------------------------------------------- sessions (A/B)


MONITOR_DAY = "2024-01-01"


def _sess(spark, d):
    return A.a_sessions(Tables(spark, d))


def _monitor(spark, d):
    return _sess(spark, d).where(F.col("session_date") == F.lit(MONITOR_DAY).cast("date"))


def _nsize(spark, d):
    return S.required_sample_size(_sess(spark, d))


query("top_user_sessions")(lambda spark, d: S.top_user_sessions(_sess(spark, d)))
query("daily_registration")(lambda spark, d: S.daily_registration(_sess(spark, d)))
query("daily_registration__means")(lambda spark, d: S.daily_registration_means(_sess(spark, d)))
query("page_counter_dist")(lambda spark, d: S.page_counter_dist(_sess(spark, d)))
query("page_counter_dist__stats")(lambda spark, d: S.page_counter_stats(_sess(spark, d)))
query("daily_good_sessions")(lambda spark, d: S.daily_good_sessions(_sess(spark, d)))
query("daily_good_sessions__stats")(lambda spark, d: S.daily_good_sessions_stats(_sess(spark, d)))
query("required_sample_size")(_nsize)
query("test_duration")(lambda spark, d: S.test_duration(
    _sess(spark, d), _nsize(spark, d).where(F.col("segment") == "all")))
query("group_size_balance")(lambda spark, d: S.group_size_balance(_monitor(spark, d)))
query("group_size_balance__by_day")(lambda spark, d: S.group_size_by_day(_sess(spark, d)))
query("group_overlap")(lambda spark, d: S.group_overlap(_monitor(spark, d)))
query("attribute_balance")(lambda spark, d: S.attribute_balance(_monitor(spark, d), "device"))
query("attribute_balance__region")(lambda spark, d: S.attribute_balance(_monitor(spark, d), "region"))
query("daily_sessions_ttest")(lambda spark, d: S.daily_sessions_ttest(_sess(spark, d)))
query("group_performance")(lambda spark, d: S.group_performance(_sess(spark, d)))
query("proportions_ztest")(lambda spark, d: S.proportions_ztest(_sess(spark, d)))
query("lift_confint")(lambda spark, d: S.lift_confint(_sess(spark, d)))


# ------------------------------------------------------------- cohort hygiene / hours study

TEST = "interface_eu_test"


def _raw_hours(spark, d):
    return A.b_user_hours(_user_hours(spark, d), BOOK_CITIES)


def _hours(spark, d):
    """The hours file of the mart (M13) without repeated users: one lazy chain."""
    return C.dedup_users(_raw_hours(spark, d))


query("dedup_users")(_hours)
query("dedup_users__count")(lambda spark, d: C.dedup_users_count(
    A.b_user_hours(_user_hours(spark, d), BOOK_CITIES)))
query("group_describe")(lambda spark, d: C.group_describe(_hours(spark, d), "city", "hours"))
query("welch_ttest")(lambda spark, d: C.welch_ttest(_hours(spark, d), "city", "hours", *BOOK_CITIES))
query("density_histogram")(lambda spark, d: C.hours_histogram(_hours(spark, d), "city", "hours", 30))


def _tp(spark, d):
    t = Tables(spark, d)
    return A.t_events(t), A.t_participants(t)


query("clean_participants")(lambda spark, d: C.clean_participants(_tp(spark, d)[1], TEST))
query("clean_participants__groups")(lambda spark, d: C.clean_participants_groups(_tp(spark, d)[1], TEST))
query("clean_participants__duplicates")(lambda spark, d: C.participants_duplicates(_tp(spark, d)[1]))
query("clean_participants__events_duplicates")(lambda spark, d: C.events_duplicates(_tp(spark, d)[0]))
query("clean_participants__crossover")(lambda spark, d: C.crossover(_tp(spark, d)[1], TEST))
query("lifetime_events")(lambda spark, d: C.lifetime_events(*_tp(spark, d), TEST, 7))
query("group_conversion")(lambda spark, d: C.group_conversion(*_tp(spark, d), TEST))
query("proportions_ztest__abtest")(lambda spark, d: C.conversion_ztest(*_tp(spark, d), TEST))


# ------------------------------------------------------------- places

CENTER = "brand#4"


def _ip(spark, d):
    t = Tables(spark, d)
    return A.p_info(t), A.p_price(t)


def _places(spark, d):
    return P.merge_and_dedup(*_ip(spark, d))


query("profile")(lambda spark, d: profile(P._merged(*_ip(spark, d), P.NORMALISED), "places"))
query("merge_and_dedup")(_places)
query("merge_and_dedup__duplicates")(lambda spark, d: P.merge_duplicates(*_ip(spark, d)))
query("round_the_clock_share")(lambda spark, d: P.round_the_clock_share(_places(spark, d)))
query("value_share")(lambda spark, d: P.category_share(_places(spark, d)))
query("value_share__district")(lambda spark, d: P.share_of_rows(_places(spark, d), "district"))
query("value_share__center_category")(lambda spark, d: P.category_share(
    _places(spark, d), F.col("district") == CENTER))
query("chain_share")(lambda spark, d: P.chain_share(_places(spark, d)))
query("chain_share__overall")(lambda spark, d: P.chain_share_overall(_places(spark, d)))
query("seats_summary")(lambda spark, d: P.seats_summary(_places(spark, d)))
query("seats_summary__describe")(lambda spark, d: P.seats_describe(_places(spark, d)))
query("seats_summary__large")(lambda spark, d: P.seats_large(_places(spark, d)))
query("rating_by_category")(lambda spark, d: P.rating_by_category(_places(spark, d)))
query("rating_by_category__describe")(lambda spark, d: P.rating_describe(_places(spark, d)))
query("rating_by_price")(lambda spark, d: P.rating_by_price(_places(spark, d)))
query("top_chains")(lambda spark, d: P.top_chains(_places(spark, d)))
query("top_chains__categories")(lambda spark, d: P.top_chain_categories(_places(spark, d)))
query("bill_vs_center")(lambda spark, d: P.bill_vs_center(_places(spark, d), CENTER))
query("density_histogram__rating")(lambda spark, d: density_histogram(_places(spark, d), "rating", bins=20))


# ------------------------------------------------------------- startups


def _cr(spark, d):
    return A.s_company_and_rounds(Tables(spark, d))


def _nc(spark, d):
    return SU.normalize_companies_rounds(_cr(spark, d))


def _final(spark, d):
    t = Tables(spark, d)
    cand = SU.candidate_companies(SU.normalize_companies_rounds(A.s_company_and_rounds(t)))
    return SU.acquisition_enrichment(cand, A.s_acquisition(t))


def _symbolic(spark, d):
    return SU.symbolic_sales(_final(spark, d), A.s_acquisition(Tables(spark, d)))


def _frames(spark, d):
    t = Tables(spark, d)
    return {"company_and_rounds": A.s_company_and_rounds(t), "people": A.s_people(t), "fund": A.s_fund(t)}


def _cps(spark, d, order_by):
    return SU.category_price_stats(_final(spark, d), A.s_acquisition(Tables(spark, d)), order_by=order_by)


query("clean_headers_and_dates")(lambda spark, d: SU.clean_headers_and_dates(
    _cr(spark, d), ["founded_at", "closed_at"]))
query("clean_headers_and_dates__raw")(lambda spark, d: SU.clean_headers_and_dates(
    A.s_raw_rounds(Tables(spark, d)), ["founded_at", "closed_at", "funded_at", "acquired_at", "graduated_at"]))
for _name, _view in {"acquisition": A.s_acquisition, "people": A.s_people, "education": A.s_education, "fund": A.s_fund,
                     "rest_info": A.p_info, "rest_price": A.p_price}.items():
    query(f"profile__{_name}")(lambda spark, d, name=_name, view=_view: profile(view(Tables(spark, d)), name))
query("profile__startups")(lambda spark, d: profile(_cr(spark, d), "company_and_rounds"))
query("funding_by_year")(lambda spark, d: SU.funding_by_year(_cr(spark, d), 50))
query("education_gap_by_company_size")(lambda spark, d: SU.education_gap_by_company_size(
    A.s_people(Tables(spark, d)), A.s_education(Tables(spark, d))))
query("join_key_suitability")(lambda spark, d: SU.join_key_suitability(_frames(spark, d), "network_username"))
query("join_key_suitability__pairs")(lambda spark, d: SU.join_key_overlaps(_frames(spark, d), "network_username"))
query("normalize_companies_rounds")(_nc)
query("normalize_companies_rounds__rounds")(lambda spark, d: SU.split_rounds(_cr(spark, d)))
query("candidate_companies")(lambda spark, d: SU.candidate_companies(_nc(spark, d)))
query("candidate_companies__status")(lambda spark, d: SU.status_shares(SU.candidate_companies(_nc(spark, d))))
query("candidate_companies__missing")(lambda spark, d: SU.missing_stats(SU.candidate_companies(_nc(spark, d))))
query("acquisition_enrichment")(_final)
query("status_consistency")(lambda spark, d: SU.status_consistency(_final(spark, d)))
query("funding_summary")(lambda spark, d: SU.funding_summary(_final(spark, d)))
query("symbolic_sales")(_symbolic)
query("symbolic_sales__describe")(lambda spark, d: _describe(_symbolic(spark, d), "funding_total"))
query("iqr_outlier_bounds")(lambda spark, d: _iqr(_symbolic(spark, d), "funding_total", 1.5))
query("category_price_stats")(lambda spark, d: _cps(spark, d, "median_price"))
query("category_price_stats__by_iqr")(lambda spark, d: _cps(spark, d, "iqr_price"))
query("category_price_stats__by_std")(lambda spark, d: _cps(spark, d, "std_price"))
query("rounds_by_status")(lambda spark, d: SU.rounds_by_status(_final(spark, d)))
query("rounds_by_status__values")(lambda spark, d: SU.distinct_values(_final(spark, d), "funding_rounds"))


# ------------------------------------------------------------- game


def _g(spark, d):
    t = Tables(spark, d)
    return A.g_users(t), A.g_events(t), A.g_items(t)


query("payer_share")(lambda spark, d: G.payer_share(_g(spark, d)[0]))
query("payer_share_by_race")(lambda spark, d: G.payer_share_by_race(_g(spark, d)[0]))
query("purchase_stats")(lambda spark, d: G.purchase_stats(_g(spark, d)[1]))
query("zero_purchases")(lambda spark, d: G.zero_purchases(_g(spark, d)[1]))
query("buyers_by_payer")(lambda spark, d: G.buyers_by_payer(*_g(spark, d)[:2]))
query("item_popularity")(lambda spark, d: G.item_popularity(*_g(spark, d)))
query("item_popularity__top")(lambda spark, d: G.item_popularity(*_g(spark, d), k=3))
query("race_activity")(lambda spark, d: G.race_activity(*_g(spark, d)[:2]))
query("activity_tiers")(lambda spark, d: G.activity_tiers(G.race_activity(*_g(spark, d)[:2])))


# ------------------------------------------------------------- talks


def _k(spark, d):
    t = Tables(spark, d)
    return A.k_conferences(t), A.k_talks(t)


query("conference_totals")(lambda spark, d: K.conference_totals(*_k(spark, d)))
query("conference_drilldown")(lambda spark, d: K.conference_drilldown(*_k(spark, d)))
query("top_funny_talks")(lambda spark, d: K.top_funny_talks(_k(spark, d)[1]))
query("top_tags")(lambda spark, d: K.top_tags(_k(spark, d)[1]))
query("occupations_by_applause")(lambda spark, d: K.occupations_by_applause(_k(spark, d)[1]))
query("speakers_and_length")(lambda spark, d: K.speakers_and_length(*_k(spark, d)))
query("talk_detail")(lambda spark, d: K.talk_detail(*_k(spark, d)))


# ------------------------------------------------------------- places: association (phi_K)

query("phik_matrix")(lambda spark, d: P.rating_association(_places(spark, d)))
query("phik_matrix__chi2")(lambda spark, d: P.rating_association(_places(spark, d), with_phik=False))
query("phik_matrix__strongest")(lambda spark, d: strongest_correlate(
    P.rating_association(_places(spark, d)), "rating"))
query("phik_matrix__strongest_v")(lambda spark, d: strongest_correlate(
    P.rating_association(_places(spark, d), with_phik=False), "rating", metric="cramers_v"))


# ------------------------------------------------------------- files (S2-S4)


@query("zipped_csv")
def _zipped(spark, d):
    """The event log through zip archives of CSV files: one a task, read member by member."""
    events, path = Tables(spark, d).events, scratch(spark, "zipped-events")
    write_zipped_csv(events, path)
    return read_zipped_csv(spark, path, events.schema)


@query("csv_with_schema")
def _csv_with_schema(spark, d):
    """Orders through plain CSV files with an explicit schema."""
    orders, path = Tables(spark, d).orders, scratch(spark, "csv-orders")
    orders.write.option("header", True).csv(path)
    return read_csv(spark, path, orders.schema)


@query("dedup_users__index_column")
def _dedup_index_column(spark, d):
    """The hours file with its index as the first column, which decides the row that stays."""
    hours, path = _raw_hours(spark, d).select("row_idx", "puid", "city", "hours"), scratch(spark, "csv-hours")
    hours.withColumnRenamed("row_idx", "_c0").write.option("header", True).csv(path)
    schema = hours.withColumnRenamed("row_idx", "_c0").schema
    return C.dedup_users(read_csv(spark, path, schema, index_col="row_idx"))


@query("dedup_users__file_order")
def _dedup_file_order(spark, d):
    """The hours file without an index: the order of its lines decides the row that stays."""
    hours, path = _raw_hours(spark, d), scratch(spark, "csv-hours")
    columns = hours.select("puid", "city", "hours")
    hours.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select(*columns.columns).write.option(
        "header", True).csv(path)
    return C.dedup_users(read_csv_in_order(spark, path, columns.schema)).drop("row_idx")
