"""The relational surface of the supported dialects as executable queries: (Spark SQL, DuckDB SQL; None: the same text).

What Spark has no syntax for (OVERLAPS, ASOF and ANY joins, tops with ties, GROUPS frames, EXCLUDE, CONNECT BY) is written
with what it has.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL: dict[str, tuple[str, str | None]] = {
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    "projection_alias": ("SELECT o_orderkey AS k, o_totalprice * 2 AS twice, upper(o_orderstatus) AS st FROM orders", None),
    "select_distinct": ("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders", None),
    "star_except": ("SELECT * EXCEPT (s_name, s_acctbal) FROM supplier", "SELECT * EXCLUDE (s_name, s_acctbal) FROM supplier"),
    "filter_predicates": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_name LIKE '%e%' AND p_type IS NOT NULL", None),
    "ilike_rlike": ("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'auto%' OR c_name RLIKE '[0-9]*7$'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'auto%' OR regexp_matches(c_name, '[0-9]*7$')"),
    "is_distinct_from": ("SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'F') <=> 'O')", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'"),
    "having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", None),
    "values_rows": ("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(x, y)"),
    "inner_join": ("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", None),
    "left_join": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", None),
    "right_join": ("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", None),
    "full_join": ("SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 50", None),
    "cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_using": ("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) JOIN (SELECT s_nationkey AS k, s_suppkey AS b FROM supplier) USING (k)", None),
    "natural_join": ("SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer)", None),
    "nested_join": ("SELECT r_name, count(*) AS n FROM region JOIN (nation JOIN customer ON n_nationkey = c_nationkey) ON r_regionkey = n_regionkey GROUP BY r_name", None),
    "semi_join": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey"),
    "anti_join": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)"),
    "any_join": ("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey", None),
    "theta_join": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    # intervals of five minutes meet only in the same or a neighbouring slot of five minutes, so that a busy user's events don't all meet
    "overlaps": ("SELECT a.event_id AS a, b.event_id AS b FROM (SELECT *, CAST(CAST(ts AS TIMESTAMP) AS BIGINT) DIV 300 AS slot FROM events) a JOIN (SELECT *, explode(array(CAST(CAST(ts AS TIMESTAMP) AS BIGINT) DIV 300 - 1, CAST(CAST(ts AS TIMESTAMP) AS BIGINT) DIV 300, CAST(CAST(ts AS TIMESTAMP) AS BIGINT) DIV 300 + 1)) AS slot FROM events) b ON a.user_id = b.user_id AND a.slot = b.slot AND a.event_id < b.event_id AND a.ts < b.ts + INTERVAL 5 MINUTES AND b.ts < a.ts + INTERVAL 5 MINUTES", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.ts < b.ts + INTERVAL 5 MINUTE AND b.ts < a.ts + INTERVAL 5 MINUTE"),
    # an as-of join without a join: both sides in one ordered window, the last purchase carried forward
    "asof_join": ("SELECT event_id, at AS purchase_at FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM events) WHERE event_type <> 'purchase'",
                  "SELECT e.event_id, max(p.ts) AS purchase_at FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type <> 'purchase' GROUP BY e.event_id"),
    "lateral_subquery": ("SELECT n_nationkey, x.n FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) AS x", None),
    "lateral_view_explode": ("SELECT r_regionkey, w FROM region LATERAL VIEW explode(split(r_name, '')) t AS w WHERE w <> ''", "SELECT r_regionkey, unnest(string_split(r_name, '')) AS w FROM region"),
    "group_by_expression": ("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", None),
    "group_by_ordinal": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2", None),
    "group_by_all": ("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL", None),
    "cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "grouping_sets": ("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())", None),
    "distinct_aggregate": ("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority", None),
    "filter_aggregate": ("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus", None),
    "ordered_aggregate": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "percentile_within_group": ("SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med FROM lineitem GROUP BY l_returnflag", None),
    "pivot": ("SELECT * FROM (SELECT o_orderstatus, year(o_orderdate) AS y, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT year(o_orderdate) AS y, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1"),
    "unpivot": ("SELECT * FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS bal FROM supplier) UNPIVOT (v FOR kind IN (nation, bal))", "SELECT s_suppkey, 'nation' AS kind, CAST(s_nationkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT s_suppkey, 'bal', s_acctbal FROM supplier WHERE s_acctbal IS NOT NULL"),
    "window_rank": ("SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)", None),
    "window_offset": ("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later FROM orders", None),
    "window_rows_frame": ("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM lineitem", None),
    "window_range_interval": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events", None),
    "window_groups_frame": ("SELECT p_partkey, sum(1) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part)", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part"),
    "window_exclude_current": ("SELECT n_nationkey, sum(n_nationkey) OVER (PARTITION BY n_regionkey) - n_nationkey AS rest FROM nation", None),
    "window_ignore_nulls": ("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click FROM events"),
    "qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1"),
    "order_limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5", None),
    # the fifth largest value bounds the ties: a top-k of each partition instead of one window over all rows
    "top_with_ties": ("SELECT p_partkey FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 5))", "SELECT p_partkey FROM (SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5"),
    "limit_by": ("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 2", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT c_nationkey, round(max(t), 2) AS m FROM a JOIN customer ON k = c_custkey GROUP BY c_nationkey) SELECT n_name, m FROM b JOIN nation ON n_nationkey = c_nationkey", None),
    "recursive_cte": ("WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t", None),
    "connect_by": ("WITH RECURSIVE t(k, lvl) AS (SELECT n_nationkey, 1 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, lvl + 1 FROM t JOIN nation n ON n.n_nationkey = 2 * k + 1 OR n.n_nationkey = 2 * k + 2) SELECT k, lvl FROM t", None),
    "scalar_subquery": ("SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)", None),
    "exists_subquery": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)", None),
    "not_in_subquery": ("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", None),
    "case_cast": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c, CAST(o_custkey AS STRING) AS s FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c, CAST(o_custkey AS VARCHAR) AS s FROM orders"),
    "string_functions": ("SELECT n_nationkey, substring(n_name, 2, 3) AS a, trim(BOTH 'A' FROM n_name) AS b, position('A' IN n_name) AS c, n_name || '-' || n_regionkey AS d FROM nation", None),
    "date_functions": ("SELECT o_orderkey, extract(MONTH FROM o_orderdate) AS m, date_trunc('MONTH', o_orderdate) AS t, o_orderdate + INTERVAL 1 DAY AS n FROM orders", None),
    "arithmetic_bitwise": ("SELECT p_partkey, p_size % 7 AS m, p_size & 5 AS a, p_size | 8 AS o, shiftleft(p_size, 2) AS s, p_size DIV 3 AS d FROM part", "SELECT p_partkey, p_size % 7 AS m, p_size & 5 AS a, p_size | 8 AS o, p_size << 2 AS s, p_size // 3 AS d FROM part"),
    "lambda_transform": ("SELECT r_regionkey, aggregate(transform(sequence(1, 4), x -> x * r_regionkey), 0, (a, x) -> a + x) AS s FROM region", "SELECT r_regionkey, CAST(list_sum(list_transform([1, 2, 3, 4], lambda x: x * r_regionkey)) AS INTEGER) AS s FROM region"),
    "tumbling_window": ("SELECT window.start AS w, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Registers the tables that a text names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = SQL[name][0]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(name) for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: duck or own for name, (own, duck) in SQL.items()}
