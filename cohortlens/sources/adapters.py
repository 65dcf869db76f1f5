"""Adapter views: bind the study schemas onto the driver's TPC-H-ish tables.

Each function returns the view of one study table as a lazy DataFrame built
from ``Tables``.  The mapping is deterministic; nulls, duplicates and
overlaps are introduced with ``CASE``-style expressions so every operator's
null / tie / dedup rule is exercised.  No view caps its input by id: each
one grows with the tables it reads.

Scale notes: fact-side work (lineitem, orders, events) is pre-aggregated
before joins where the view groups anyway (``r_flats``); dimension joins
(region, nation, supplier) are broadcast because their size is fixed by the
schema (5 / 25 rows) or bounded by the supplier dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlens.sources.tables import Tables


def _int(c):
    return c.cast("int")


def _first_number(col: str):
    return F.regexp_extract(F.col(col), r"([0-9]+)", 1).cast("int")


# ---------------------------------------------------------------- delivery
def d_cities(t: Tables) -> DataFrame:
    return t.region.select(_int(F.col("r_regionkey")).alias("city_id"),
                           F.col("r_name").alias("city_name"))


def _user_region(t: Tables) -> DataFrame:
    nat = t.nation.select("n_nationkey", "n_regionkey")
    return (t.customer.select("c_custkey", "c_nationkey")
            .join(F.broadcast(nat), F.col("c_nationkey") == F.col("n_nationkey")))


def d_events(t: Tables) -> DataFrame:
    shift = _int(F.col("user_id") % 2 * 31)
    ev = t.events.select("user_id", "event_type",
                         F.date_add(F.to_date("ts"), shift).alias("log_date"))
    first = (ev.where(F.col("event_type") == "signup")
             .groupBy("user_id").agg(F.min("log_date").alias("first_date")))
    cust = _user_region(t)
    return (ev.join(cust, ev.user_id == cust.c_custkey)
            .join(first, "user_id", "left")
            .select("user_id", "log_date", "first_date",
                    F.when(F.col("event_type") == "purchase", F.lit("order"))
                     .otherwise(F.col("event_type")).alias("event"),
                    _int(F.col("n_regionkey")).alias("city_id")))


def d_sales(t: Tables) -> DataFrame:
    nat = t.nation.select("n_nationkey", "n_regionkey")
    sup = (t.supplier.select("s_suppkey", "s_nationkey")
           .join(F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey")))
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag",
                           "l_extendedprice", "l_discount")
    o = t.orders.select("o_orderkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(sup, li.l_suppkey == sup.s_suppkey)
            .select(F.col("l_orderkey").alias("order_id"),
                    F.to_date("o_orderdate").alias("log_date"),
                    F.col("l_suppkey").alias("rest_id"),
                    F.col("l_partkey").alias("object_id"),
                    _int(F.col("n_regionkey")).alias("city_id"),
                    F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double"))
                     .otherwise(F.col("l_extendedprice")).alias("revenue"),
                    F.col("l_discount").alias("commission")))


def d_partners(t: Tables) -> DataFrame:
    nat = t.nation.select("n_nationkey", "n_regionkey")
    return (t.supplier.join(F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("rest_id"),
                    _int(F.col("n_regionkey")).alias("city_id"),
                    F.col("s_name").alias("chain"),
                    F.when(F.col("s_suppkey") % 2 == 0, "cafe").otherwise("bar").alias("type")))


def d_dishes(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_partkey"), F.col("l_suppkey")).distinct()
    p = t.part.select("p_partkey", "p_name", "p_size")
    return (pairs.join(p, pairs.l_partkey == p.p_partkey)
            .select(F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("rest_id"),
                    F.col("p_name").alias("name"),
                    (F.col("p_size") % 2).alias("spicy"), (F.col("p_size") % 3).alias("fish"),
                    (F.col("p_size") % 5).alias("meat")))


# ---------------------------------------------------------------- books
def b_audition(t: Tables) -> DataFrame:
    shift = _int(F.col("user_id") % 3 * 31)
    return t.events.select(
        F.col("user_id").alias("puid"),
        F.date_add(F.to_date("ts"), shift).alias("msk_business_dt"),
        _first_number("props").alias("main_content_id"),
        _int(F.col("user_id") % 25).alias("usage_geo_id"),
        F.col("value").alias("hours"))


def b_content(t: Tables) -> DataFrame:
    return t.part.select(_int(F.col("p_partkey")).alias("main_content_id"),
                         _int(F.col("p_partkey") % 7).alias("main_author_id"),
                         F.col("p_name").alias("main_content_name"),
                         F.col("p_type").alias("published_topic_title_list"))


def b_author(t: Tables) -> DataFrame:
    k = _int(F.col("p_partkey") % 7)
    return (t.part.select(k.alias("main_author_id")).distinct()
            .select("main_author_id",
                    F.concat(F.lit("author "), F.col("main_author_id").cast("string"))
                     .alias("main_author_name")))


def b_geo(t: Tables) -> DataFrame:
    return (t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(_int(F.col("n_nationkey")).alias("usage_geo_id"),
                    F.col("r_name").alias("usage_geo_id_name")))


def b_user_hours(mart: DataFrame, cities: Sequence[str]) -> DataFrame:
    """The per-user hours file handed to the tests: the mart (city, puid,
    hours) in file order, where every ninth user id has a second row that
    names the other city, one hour more."""
    a, b = cities
    other = F.when(F.col("city") == a, b).otherwise(a)
    again = F.when(F.col("puid") % 9 == 0, F.struct((2 * F.col("puid") + 1).alias("row_idx"), other.alias("city"),
                                                    (F.col("hours") + 1).alias("hours")))
    first = F.struct((2 * F.col("puid")).alias("row_idx"), "city", "hours")
    rows = F.explode(F.array_compact(F.array(first, again)))
    return mart.select("puid", rows.alias("r")).select("r.row_idx", "puid", "r.city", "r.hours")


# ---------------------------------------------------------------- realty
def r_flats(t: Tables) -> DataFrame:
    # Pre-aggregate lineitem per order before joining (one row per order).
    per_order = (t.lineitem.groupBy("l_orderkey")
                 .agg(F.sum("l_quantity").alias("total_area"),
                      F.count("l_linenumber").alias("n_lines")))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    c = t.customer.select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
            .select(k.alias("id"), F.col("total_area"),
                    F.when(k % 11 == 0, F.lit(None))
                     .otherwise(_int(F.coalesce(F.col("n_lines"), F.lit(0)))).alias("rooms"),
                    F.when(k % 3 == 0, F.lit(None)).otherwise(_int(k % 6)).alias("balcony"),
                    F.when(k % 5 == 0, F.lit(None))
                     .otherwise(2 + (k % 37).cast("double") / 20).alias("ceiling_height"),
                    F.col("c_nationkey").alias("city_id"),
                    F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("is_apartment")))


def r_advertisement(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), F.to_date("o_orderdate").alias("first_day_exposition"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(_int(k % 400)).alias("days_exposition"),
        F.col("o_totalprice").alias("last_price"))


def r_city(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"))


# ---------------------------------------------------------------- sessions
def a_sessions(t: Tables) -> DataFrame:
    """One row per session.  ``install_date`` (first active day of the user)
    is a per-user aggregate joined back - map-side combined, and AQE splits a
    hot user on the join - rather than a window that would put all sessions
    of one user in one task."""
    nat = t.nation.select("n_nationkey", "n_regionkey")
    reg = t.region.select("r_regionkey", "r_name")
    geo = (t.customer.select("c_custkey", "c_nationkey")
           .join(F.broadcast(nat), F.col("c_nationkey") == F.col("n_nationkey"))
           .join(F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey")))
    e = t.events.select("user_id", "event_id", "ts", "event_type", "props")
    install = e.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("install_date"))
    u = F.col("user_id")
    # Left join: no row is lost (every user has a first day) and Catalyst
    # drops the aggregate entirely for queries that do not read install_date.
    return (e.join(geo, e.user_id == geo.c_custkey).join(install, "user_id", "left")
            .select(u, F.col("event_id").alias("session_id"),
                    F.to_date("ts").alias("session_date"),
                    F.col("ts").alias("session_start_ts"), "install_date",
                    F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("registration_flag"),
                    (1 + _first_number("props") % 7).alias("page_counter"),
                    F.col("r_name").alias("region"),
                    F.when(u % 4 == 0, "Android").when(u % 4 == 1, "iPhone")
                     .when(u % 4 == 2, "PC").otherwise("Mac").alias("device"),
                    F.when((u % 5).isin(0, 2, 3), "A").otherwise("B").alias("test_group")))


# ---------------------------------------------------------------- abtest
def t_participants(t: Tables) -> DataFrame:
    """Participants of two tests.  The registry is the set of customers seen
    in ``events`` (semi join), so it grows with the event stream.  One pass:
    each customer emits up to three enrolment rows (main test, competing
    test, and a duplicated main-test row), exploded from an array."""
    seen = t.events.select(F.col("user_id").alias("c_custkey")).distinct()
    c = t.customer.select("c_custkey").join(seen, "c_custkey", "left_semi")
    k = F.col("c_custkey")
    ab = F.when(k % 2 == 0, "A").otherwise("B")

    def row(cond, grp, test):
        return F.when(cond, F.struct(k.alias("user_id"), grp.alias("grp"), F.lit(test).alias("ab_test")))

    rows = F.array(row(k % 3 != 0, ab, "interface_eu_test"),
                   row(k % 7 == 0, F.when(k % 4 == 0, "A").otherwise("B"), "recommender_system_test"),
                   row((k % 3 != 0) & (k % 10 == 1), ab, "interface_eu_test"))
    return (c.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r"))
            .select("r.user_id", "r.grp", "r.ab_test"))


def t_events(t: Tables) -> DataFrame:
    """Event log; most purchases are relabelled ``product_cart`` so that
    conversion stays below 100 % without dropping rows."""
    et = F.col("event_type")
    name = (F.when(et == "signup", "registration")
             .when((et == "purchase") & (F.col("event_id") % 30 != 0), "product_cart")
             .otherwise(et))
    return t.events.select("user_id", F.col("ts").alias("event_dt"), name.alias("event_name"),
                           F.when(name == "purchase", F.col("props")).alias("details"))


# ---------------------------------------------------------------- places
def p_info(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("id"), F.col("p_name").alias("name"),
        F.concat(F.lit("Addr "), (k % 10).cast("string")).alias("address"),
        F.col("p_brand").alias("district"), F.col("p_type").alias("category"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 12 == 0, "Ежедневно, круглосуточно")
         .otherwise("пн-пт 10:00–20:00").alias("hours"),
        (1 + (k % 41).cast("double") / 10).alias("rating"),
        F.when(k % 3 == 0, 1).otherwise(0).alias("chain"),
        F.when(k % 5 < 2, F.lit(None)).otherwise((F.col("p_size") * (k % 9)).cast("double"))
         .alias("seats"))


def p_price(t: Tables) -> DataFrame:
    """Price card keyed ``2 * p_partkey``: half the ids fall outside ``p_info``
    and half of ``p_info`` has no card, so a full outer merge has nulls on
    both sides."""
    k = F.col("p_partkey")
    return t.part.select(
        (k * 2).alias("id"),
        F.when(k % 5 == 0, "низкие").when(k % 5 == 1, "средние")
         .when(k % 5 == 2, "выше среднего").when(k % 5 == 3, "высокие").alias("price"),
        F.when(k % 8 == 0, F.lit(None)).otherwise("Средний счёт: 1000–1500 ₽").alias("avg_bill"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("middle_avg_bill"),
        F.when(k % 10 == 0, F.col("p_retailprice") / 10).alias("middle_coffee_cup"))


# ---------------------------------------------------------------- startups
def s_company_and_rounds(t: Tables) -> DataFrame:
    c = t.customer
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    ck = F.col("c_custkey")
    ok = F.col("o_orderkey")
    j = c.join(o, (ck == F.col("o_custkey")) & (ck % 10 != 0), "left")
    return j.select(
        ck.alias("company_ID"), F.col("c_name").alias("name"),
        F.when(ck % 8 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("category_code"),
        F.when(ck % 4 == 0, "acquired").when(ck % 19 == 0, "closed").when(ck % 61 == 0, "ipo")
         .otherwise("operating").alias("status"),
        F.when(ck % 3 == 0, "bad-date").otherwise("1994-03-01").alias("founded_at"),
        F.when(ck % 19 == 0, F.when(ck % 2 == 0, "1996-07-15").otherwise("1996-02-31")).alias("closed_at"),
        F.concat(F.lit("c"), ck.cast("string"), F.lit(".example")).alias("domain"),
        F.concat(F.lit("u"), ck.cast("string")).alias("network_username"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country_code"),
        _int(ck % 5).alias("milestones"),
        _int(ck % 2).alias("investment_rounds"), _int(ck % 4).alias("funding_rounds"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 1000).otherwise(0.0).alias("funding_total"),
        ok.alias("funding_round_id"), F.col("o_custkey").alias("company_id_round"),
        F.to_date("o_orderdate").alias("funded_at"), F.col("o_orderpriority").alias("funding_round_type"),
        F.when(ok % 9 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("raised_amount"),
        F.when(ok % 5 == 0, F.col("o_totalprice") * 4).alias("pre_money_valuation"),
        _int(ok % 6).alias("participants"), _int(ok % 2).alias("is_first_round"),
        F.when(ok % 3 == 0, 1).otherwise(F.when(ok.isNotNull(), 0)).alias("is_last_round"))


def s_raw_rounds(t: Tables) -> DataFrame:
    """Rounds as their file has them: headers with runs of two spaces, dates as text."""
    ok = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(
        F.col("o_custkey").alias("company  ID"), ok.alias("funding  round  id"),
        F.when(ok % 3 == 0, "bad-date").otherwise(day).alias("founded  at"),
        F.when(ok % 4 == 0, "1996-02-31").when(ok % 4 == 1, day).alias("closed  at"),
        F.when(ok % 5 != 0, day).alias("funded  at"),
        F.when(ok % 7 == 0, "").otherwise(day).alias("acquired  at"),
        F.when(ok % 11 == 0, "soon").otherwise(day).alias("graduated  at"))


def s_acquisition(t: Tables) -> DataFrame:
    # Re-keyed so that every customer row is a deal: the company ids that are
    # "acquired" are the multiples of four, and one in seven of them is skipped.
    k = 4 * (F.col("c_custkey") + F.floor(F.col("c_custkey") / 6))
    return (t.customer
            .select(k.alias("id"), (k + 1).alias("acquiring_company_id"), k.alias("acquired_company_id"),
                    F.when(k % 20 == 0, "cash").alias("term_code"),
                    F.when(k % 12 == 0, 0.0).when(k % 20 == 0, 1.0)
                     .otherwise(F.col("c_acctbal") * 500).alias("price_amount"),
                    F.when(k % 40 == 0, F.lit(None))
                     .otherwise(F.date_add(F.lit("2000-01-01").cast("date"), _int(k % 9000))).alias("acquired_at")))


def s_people(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("company_id"),
        F.when(k % 5 == 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).alias("network_username"))


def s_education(t: Tables) -> DataFrame:
    return (t.lineitem
            .select(F.col("l_orderkey").alias("person_id"),
                    F.when(F.col("l_partkey") % 50 == 0, F.lit(None))
                     .otherwise(F.concat(F.lit("inst "), F.col("l_suppkey").cast("string")))
                     .alias("instituition"),
                    F.when(F.col("l_partkey") % 2 == 0, F.to_date("l_shipdate")).alias("graduated_at")))


def s_fund(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), F.col("s_name").alias("name"),
                             F.when(k % 5 == 0, F.concat(F.lit("u"), k.cast("string")))
                              .alias("network_username"))


# ---------------------------------------------------------------- game
def g_users(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("race"),
                             F.when(F.col("c_acctbal") > 8000, 1).otherwise(0).alias("payer"))


def g_events(t: Tables) -> DataFrame:
    return (t.events.where(F.col("event_type") == "purchase")
            .select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("id"),
                    _first_number("props").alias("item_code"),
                    F.when(F.col("event_id") % 97 == 0, 0.0).otherwise(F.col("value")).alias("amount")))


def g_items(t: Tables) -> DataFrame:
    return t.part.select(_int(F.col("p_partkey")).alias("item_code"), F.col("p_name").alias("game_items"))


# ---------------------------------------------------------------- talks
def k_conferences(t: Tables) -> DataFrame:
    return (t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("conference_id"), F.col("n_name").alias("conference"),
                    F.col("r_name").alias("country")))


def k_talks(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("talk_id"), _int(k % 20).alias("conference_id"), F.col("p_brand").alias("speaker"),
        F.col("p_type").alias("occupation"), F.col("p_name").alias("tags_text"),
        F.col("p_size").alias("duration_min"), (k * 7919 % 100000).cast("bigint").alias("views"),
        _int(k * 31 % 50).alias("applause"), _int(k * 17 % 997).alias("funny"))
