"""Relational SQL over the driver tables: the same text for Spark and for the oracle, by operator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.dialect import translate
from tessera.sources.tables import NAMES, register

#: name: statement. Money goes through decimals or rounds, so that sums don't depend on order.
STATEMENTS: dict[str, str] = {
    "sql_project_filter": "SELECT o_orderkey, o_totalprice * 2 AS twice, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IS NOT NULL",
    "sql_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name NOT LIKE '%e%'",
    "sql_join_inner": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "sql_join_left": "SELECT c.c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 GROUP BY c.c_custkey",
    "sql_join_right": "SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "sql_join_full": "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_suppkey",
    "sql_join_using": "SELECT x.k, x.n, y.m FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) x JOIN (SELECT r_regionkey AS k, max(r_name) AS m FROM region GROUP BY r_regionkey) y ON x.k = y.k",
    "sql_join_theta": "SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a JOIN nation b ON b.n_nationkey BETWEEN a.r_regionkey * 3 AND a.r_regionkey * 3 + 4",
    "sql_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "sql_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "sql_scalar_subquery": "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
    "sql_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_group_having": "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_aggregates": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_aggregate_filter": "SELECT event_type, count(*) FILTER (WHERE value > 10) AS big, count(*) AS n FROM events GROUP BY event_type",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "sql_union": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "sql_union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "sql_intersect": "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'",
    "sql_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "sql_window_rank": "SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)",
    "sql_window_share": "SELECT s_suppkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM supplier WINDOW w AS (ORDER BY s_acctbal)",
    "sql_window_shift": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_id) OVER w AS head, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "sql_window_rows": "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events",
    "sql_window_range": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_order_offset": "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 30",
    "sql_cte": "WITH big AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT c.c_mktsegment, count(*) AS n FROM big JOIN customer c ON c.c_custkey = big.o_custkey WHERE m > 300000 GROUP BY c.c_mktsegment",
    "sql_recursive": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "sql_values": "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(i, s)",
    "sql_is_distinct": "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 0) IS NOT DISTINCT FROM NULL",
    "sql_strings": "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS len, replace(n_name, '_', '-') AS r, substr(n_name, 2, 3) AS s, instr(n_name, '_') AS i, trim(concat(' ', n_name, ' ')) AS t FROM nation",
    "sql_math": "SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(sign(s_acctbal) AS BIGINT) AS g, round(sqrt(abs(s_acctbal)), 6) AS q, s_suppkey % 7 AS m FROM supplier",
    "sql_nulls": "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), 99) AS c, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END AS n FROM nation",
    "sql_in_list_cast": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,1)) AS p FROM orders WHERE o_orderkey IN (1, 5, 9)",
    "sql_scan_pk": "SELECT * FROM part WHERE p_partkey = 17",
    "sql_scan_range": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 100 AND o_orderkey <= 400",
    "sql_revenue_q1": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "sql_star_join": "SELECT r.r_name, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
}

#: name: (statement in the session's dialect, the oracle's text).
DIALECT: dict[str, tuple[str, str]] = {
    "sql_casts_stripped": ("SELECT o_orderkey::text AS k, o_totalprice::decimal(9, 1) AS p FROM orders WHERE o_orderstatus == 'F'", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F'"),
    "sql_glob": ("SELECT p_partkey FROM part WHERE p_name GLOB '*[a-m]in*' OR p_name NOT GLOB '*e*'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[a-m]in') OR p_name NOT LIKE '%e%'"),
    "sql_join_natural": ("SELECT n, m, k FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) NATURAL JOIN (SELECT r_regionkey AS k, max(r_name) AS m FROM region GROUP BY 1)",) * 2,
    "sql_total": ("SELECT c_mktsegment, round(total(c_acctbal), 2) AS t, total(CASE WHEN c_acctbal > 1e9 THEN 1 END) AS z FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, round(coalesce(sum(c_acctbal), 0), 2) AS t, 0.0::DOUBLE AS z FROM customer GROUP BY c_mktsegment"),
    "sql_group_concat": ("SELECT n_regionkey, group_concat(n_name, '; ') AS names, group_concat(DISTINCT lower(n_name)) AS low FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names, string_agg(lower(n_name), ',' ORDER BY lower(n_name)) AS low FROM nation GROUP BY n_regionkey"),
    "sql_dates": ("SELECT o_orderkey, strftime('%Y-%m', o_orderdate) AS ym, date(o_orderdate) AS d, unixepoch(o_orderdate) AS s, round(julianday(o_orderdate), 5) AS j FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, CAST(o_orderdate AS DATE) AS d, CAST(epoch(o_orderdate) AS BIGINT) AS s, round(epoch(o_orderdate) / 86400 + 2440587.5, 5) AS j FROM orders"),
    "sql_json_extract": ("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') > 50", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50"),
    "sql_iif": ("SELECT o_orderkey, iif(o_totalprice > 200000, 'much', iif(o_orderstatus == 'F', 'done', 'open')) AS k FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'much' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS k FROM orders"),
    "sql_typeof": ("SELECT c_custkey, typeof(c_custkey) AS a, typeof(c_name) AS b, typeof(c_acctbal) AS c, typeof(nullif(c_mktsegment, 'BUILDING')) AS d FROM customer", "SELECT c_custkey, 'integer' AS a, 'text' AS b, 'real' AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE 'text' END AS d FROM customer"),
    "sql_json_group_array": ("SELECT n_regionkey, json_group_array(n_nationkey) AS l FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS l FROM nation GROUP BY n_regionkey"),
}
STATEMENTS |= {
    "sql_join_using_clause": "SELECT k, x.n, y.m FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) x JOIN (SELECT r_regionkey AS k, max(r_name) AS m FROM region GROUP BY r_regionkey) y USING (k)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_window_last": "SELECT c_custkey, last_value(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM customer",
    "sql_index_equality": "SELECT o_orderkey FROM orders WHERE o_custkey = 7",
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tuple(n for n in NAMES if re.search(rf"\b{n}\b", text)))
        return spark.sql(translate(text))

    return run


QUERIES = {name: _query(text) for name, text in {**STATEMENTS, **{n: x for n, (x, _) in DIALECT.items()}}.items()}
ORACLES = {**STATEMENTS, **{n: x for n, (_, x) in DIALECT.items()}}
