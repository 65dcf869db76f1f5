"""Adapter views as DuckDB SQL over the driver's base tables.

Same bindings as ``cohortlens.sources.adapters`` but written independently in
SQL; ``with_views`` prepends the views a query mentions as CTEs, because the
oracle session only has the base tables registered.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "d_cities": "SELECT CAST(r_regionkey AS INT) AS city_id, r_name AS city_name FROM region",
    "d_events": """
SELECT e.user_id AS user_id,
       CAST(e.ts AS DATE) + CAST((e.user_id % 2) * 31 AS INT) AS log_date,
       f.first_date AS first_date,
       CASE WHEN e.event_type = 'purchase' THEN 'order' ELSE e.event_type END AS event,
       CAST(n.n_regionkey AS INT) AS city_id
FROM events e
JOIN customer c ON e.user_id = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT user_id, MIN(CAST(ts AS DATE) + CAST((user_id % 2) * 31 AS INT)) AS first_date
           FROM events WHERE event_type = 'signup' GROUP BY user_id) f ON e.user_id = f.user_id""",
    "d_sales": """
SELECT l.l_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS log_date,
       l.l_suppkey AS rest_id, l.l_partkey AS object_id, CAST(n.n_regionkey AS INT) AS city_id,
       CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE l.l_extendedprice END AS revenue,
       l.l_discount AS commission
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "d_partners": """
SELECT s.s_suppkey AS rest_id, CAST(n.n_regionkey AS INT) AS city_id, s.s_name AS chain,
       CASE WHEN s.s_suppkey % 2 = 0 THEN 'cafe' ELSE 'bar' END AS type
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "d_dishes": """
SELECT DISTINCT l.l_partkey AS object_id, l.l_suppkey AS rest_id, p.p_name AS name,
       p.p_size % 2 AS spicy, p.p_size % 3 AS fish, p.p_size % 5 AS meat
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "b_audition": """
SELECT user_id AS puid, CAST(ts AS DATE) + CAST((user_id % 3) * 31 AS INT) AS msk_business_dt,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS main_content_id,
       CAST(user_id % 25 AS INT) AS usage_geo_id, value AS hours
FROM events""",
    "b_content": """
SELECT CAST(p_partkey AS INT) AS main_content_id, CAST(p_partkey % 7 AS INT) AS main_author_id,
       p_name AS main_content_name, p_type AS published_topic_title_list
FROM part""",
    "b_author": """
SELECT DISTINCT CAST(p_partkey % 7 AS INT) AS main_author_id,
       concat('author ', CAST(CAST(p_partkey % 7 AS INT) AS VARCHAR)) AS main_author_name FROM part""",
    "b_geo": """
SELECT CAST(n.n_nationkey AS INT) AS usage_geo_id, r.r_name AS usage_geo_id_name
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "b_user_hours": """
SELECT 2 * user_id + k AS row_idx, user_id AS puid,
       CASE WHEN k = 0 THEN r_name WHEN r_name = 'ASIA' THEN 'EUROPE' ELSE 'ASIA' END AS city, listened + k AS hours
FROM (SELECT user_id, min(r_name) AS r_name,
             CAST(round(sum(CAST(value AS DECIMAL(28, 6))), 2) AS DOUBLE) AS listened
      FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON r_regionkey = n_regionkey
      WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY user_id), (VALUES (0), (1)) AS copies(k)
WHERE k = 0 OR user_id % 9 = 0""",
    "r_flats": """
SELECT o.o_orderkey AS id, SUM(l.l_quantity) AS total_area,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(COUNT(l.l_linenumber) AS INT) END AS rooms,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST(o.o_orderkey % 6 AS INT) END AS balcony,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
            ELSE 2 + CAST(o.o_orderkey % 37 AS DOUBLE) / 20 END AS ceiling_height,
       c.c_nationkey AS city_id,
       CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_apartment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderkey, c.c_nationkey, o.o_orderstatus""",
    "r_advertisement": """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS first_day_exposition,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 400 AS INT) END AS days_exposition,
       o_totalprice AS last_price
FROM orders""",
    "r_city": "SELECT n_nationkey AS city_id, n_name AS city FROM nation",
    "a_sessions": """
SELECT e.user_id AS user_id, e.event_id AS session_id, CAST(e.ts AS DATE) AS session_date,
       e.ts AS session_start_ts,
       MIN(CAST(e.ts AS DATE)) OVER (PARTITION BY e.user_id) AS install_date,
       CASE WHEN e.event_type = 'signup' THEN 1 ELSE 0 END AS registration_flag,
       1 + CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) % 7 AS page_counter,
       r.r_name AS region,
       CASE e.user_id % 4 WHEN 0 THEN 'Android' WHEN 1 THEN 'iPhone' WHEN 2 THEN 'PC' ELSE 'Mac' END AS device,
       CASE WHEN e.user_id % 5 IN (0, 2, 3) THEN 'A' ELSE 'B' END AS test_group
FROM events e
JOIN customer c ON e.user_id = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "t_participants": """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS grp,
       'interface_eu_test' AS ab_test
FROM customer WHERE c_custkey IN (SELECT user_id FROM events) AND c_custkey % 3 <> 0
UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'A' ELSE 'B' END, 'recommender_system_test'
FROM customer WHERE c_custkey IN (SELECT user_id FROM events) AND c_custkey % 7 = 0
UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END, 'interface_eu_test'
FROM customer WHERE c_custkey IN (SELECT user_id FROM events) AND c_custkey % 3 <> 0
  AND c_custkey % 10 = 1""",
    "t_events": """
SELECT user_id, ts AS event_dt, en AS event_name,
       CASE WHEN en = 'purchase' THEN props END AS details
FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 'registration'
                     WHEN event_type = 'purchase' AND event_id % 30 <> 0 THEN 'product_cart'
                     ELSE event_type END AS en
      FROM events) x""",
    "p_info": """
SELECT p_partkey AS id, p_name AS name, concat('Addr ', CAST(p_partkey % 10 AS VARCHAR)) AS address,
       p_brand AS district, p_type AS category,
       CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 12 = 0 THEN 'Ежедневно, круглосуточно'
            ELSE 'пн-пт 10:00–20:00' END AS hours,
       1 + CAST(p_partkey % 41 AS DOUBLE) / 10 AS rating,
       CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS chain,
       CASE WHEN p_partkey % 5 < 2 THEN NULL ELSE CAST(p_size * (p_partkey % 9) AS DOUBLE) END AS seats
FROM part""",
    "p_price": """
SELECT p_partkey * 2 AS id,
       CASE p_partkey % 5 WHEN 0 THEN 'низкие' WHEN 1 THEN 'средние' WHEN 2 THEN 'выше среднего'
            WHEN 3 THEN 'высокие' END AS price,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'Средний счёт: 1000–1500 ₽' END AS avg_bill,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS middle_avg_bill,
       CASE WHEN p_partkey % 10 = 0 THEN p_retailprice / 10 END AS middle_coffee_cup
FROM part""",
    "s_company_and_rounds": """
SELECT c.c_custkey AS company_ID, c.c_name AS name,
       CASE WHEN c.c_custkey % 8 = 0 THEN NULL ELSE c.c_mktsegment END AS category_code,
       CASE WHEN c.c_custkey % 4 = 0 THEN 'acquired' WHEN c.c_custkey % 19 = 0 THEN 'closed'
            WHEN c.c_custkey % 61 = 0 THEN 'ipo' ELSE 'operating' END AS status,
       CASE WHEN c.c_custkey % 3 = 0 THEN 'bad-date' ELSE '1994-03-01' END AS founded_at,
       CASE WHEN c.c_custkey % 19 = 0 THEN if(c.c_custkey % 2 = 0, '1996-07-15', '1996-02-31') END AS closed_at,
       concat('c', CAST(c.c_custkey AS VARCHAR), '.example') AS domain,
       concat('u', CAST(c.c_custkey AS VARCHAR)) AS network_username,
       concat('N', CAST(c.c_nationkey AS VARCHAR)) AS country_code, CAST(c.c_custkey % 5 AS INT) AS milestones,
       CAST(c.c_custkey % 2 AS INT) AS investment_rounds,
       CAST(c.c_custkey % 4 AS INT) AS funding_rounds,
       CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal * 1000 ELSE 0 END AS funding_total,
       o.o_orderkey AS funding_round_id, o.o_custkey AS company_id_round,
       CAST(o.o_orderdate AS DATE) AS funded_at, o.o_orderpriority AS funding_round_type,
       CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE o.o_totalprice END AS raised_amount,
       CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_totalprice * 4 END AS pre_money_valuation,
       CAST(o.o_orderkey % 6 AS INT) AS participants, CAST(o.o_orderkey % 2 AS INT) AS is_first_round,
       CAST(CAST(o.o_orderkey % 3 = 0 AS INT) AS INT) AS is_last_round
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_custkey % 10 <> 0""",
    "s_raw_rounds": """
SELECT o_custkey AS company_ID, o_orderkey AS funding_round_id,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS founded_at,
       CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) END AS closed_at,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS funded_at,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS acquired_at,
       CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS graduated_at
FROM orders""",
    "s_acquisition": """
SELECT k AS id, k + 1 AS acquiring_company_id, k AS acquired_company_id,
       CASE WHEN k % 20 = 0 THEN 'cash' END AS term_code,
       CASE WHEN k % 12 = 0 THEN 0 WHEN k % 20 = 0 THEN 1 ELSE c_acctbal * 500 END AS price_amount,
       CASE WHEN k % 40 = 0 THEN NULL ELSE DATE '2000-01-01' + CAST(k % 9000 AS INT) END AS acquired_at
FROM (SELECT 4 * (c_custkey + c_custkey // 6) AS k, c_acctbal FROM customer)""",
    "s_people": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS company_id,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('u', CAST(o_custkey AS VARCHAR)) END AS network_username
FROM orders""",
    "s_education": """
SELECT l_orderkey AS person_id, CASE WHEN l_partkey % 50 = 0 THEN NULL
            ELSE concat('inst ', CAST(l_suppkey AS VARCHAR)) END AS instituition,
       CASE WHEN l_partkey % 2 = 0 THEN CAST(l_shipdate AS DATE) END AS graduated_at
FROM lineitem""",
    "s_fund": """
SELECT s_suppkey AS id, s_name AS name,
       CASE WHEN s_suppkey % 5 = 0 THEN concat('u', CAST(s_suppkey AS VARCHAR)) END AS network_username
FROM supplier""",
    "g_users": """
SELECT c_custkey AS id, c_mktsegment AS race, CASE WHEN c_acctbal > 8000 THEN 1 ELSE 0 END AS payer
FROM customer""",
    "g_events": """
SELECT event_id AS transaction_id, user_id AS id,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS item_code,
       CASE WHEN event_id % 97 = 0 THEN 0 ELSE value END AS amount
FROM events WHERE event_type = 'purchase'""",
    "g_items": "SELECT CAST(p_partkey AS INT) AS item_code, p_name AS game_items FROM part",
    "k_conferences": """
SELECT n.n_nationkey AS conference_id, n.n_name AS conference, r.r_name AS country
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "k_talks": """
SELECT p_partkey AS talk_id, CAST(p_partkey % 20 AS INT) AS conference_id, p_brand AS speaker,
       p_type AS occupation, p_name AS tags_text, p_size AS duration_min,
       CAST(p_partkey * 7919 % 100000 AS BIGINT) AS views,
       CAST(p_partkey * 31 % 50 AS INT) AS applause, CAST(p_partkey * 17 % 997 AS INT) AS funny
FROM part""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the adapter views it references, as CTEs."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in used)
    body = sql.strip()
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
