"""The rest of the relational surface: sampling, hints, types, paths, pattern matching, changes of tables, ranks over all rows.

Each entry is (Spark, DuckDB SQL); the first is SQL text or a function of (spark, folder). What Spark has no syntax for goes
through ``rewriting``, as FETCH, TOP, LIMIT a, b and QUALIFY do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import lint_job
from . import changes, ranking, rewriting
from .relational import views


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP 10 PERCENT: the rank of each row comes from a range partition, so no task holds all rows."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey")
    ranked = ranking.ranked(rows, "o_orderkey", "rank")
    n = rows.count()
    return ranked.where(F.col("rank") <= -(-n // 10)).select("o_orderkey")


def window_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NTILE, PERCENT_RANK and CUME_DIST over all rows of a unique key, without one task for all of them."""
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey")
    n = rows.count()
    at = ranking.ranked(rows, "s_suppkey", "rank")
    large, rest = n // 4, n % 4  # the first tiles have one row more
    tile = F.when(F.col("rank") <= rest * (large + 1), F.ceil(F.col("rank") / F.lit(large + 1))).otherwise(F.lit(rest) + F.ceil((F.col("rank") - rest * (large + 1)) / F.lit(max(1, large))))
    return at.select("s_suppkey", tile.cast("int").alias("q"), F.round((F.col("rank") - 1) / F.lit(max(1, n - 1)), 6).alias("pr"), F.round(F.col("rank") / F.lit(max(1, n)), 6).alias("cd"))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_name AS name")
    b = _t(spark, sf_dir, "region").selectExpr("r_name AS name", "r_regionkey AS k", "length(r_name) AS extra")
    return a.unionByName(b, allowMissingColumns=True)


def merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    new = new.unionByName(_t(spark, sf_dir, "region").selectExpr("CAST(-1 - r_regionkey AS BIGINT) AS k", "CAST(r_regionkey AS DOUBLE) AS v"))
    old = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v")
    return changes.merge(old, new, ["k"], update={"v": F.col("source.v")}, delete=F.col("source.v") < 100000, insert={"k": F.col("source.k"), "v": F.col("source.v")})


def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.update(_t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), {"p_size": F.col("p_size") + 1}, F.col("p_brand") == "Brand#11")


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.delete(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), F.nullif(F.col("p_size"), F.lit(7)) > 10)


def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.insert(_t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation").selectExpr("n_name AS r_name", "100 + n_nationkey AS r_regionkey"))


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VERSION AS OF over a table of changes: the last change of each key up to a moment."""
    log = _t(spark, sf_dir, "events").selectExpr("user_id AS k", "event_id AS version", "ts", "round(value, 2) AS v", "event_type = 'error' AS gone")
    return changes.as_of(log, ["k"], "version", F.col("ts") <= F.lit("2024-01-03 12:00:00").cast("timestamp"), "gone").select("k", "v")


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APPLY CHANGES INTO: the orders of a customer as changes of a row, in the order of their keys."""
    target = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v")
    new = _t(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_totalprice AS v", "o_orderkey AS seq", "o_orderstatus = 'F' AS gone")
    return lint_job.apply_changes(target, new, "k", "seq", "gone")


def file_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file named in the text itself."""
    return spark.sql(f"SELECT n_regionkey, count(*) AS n FROM parquet.`{sf_dir}/nation.parquet` GROUP BY n_regionkey")


#: The pattern: a view, one click or more, a purchase, among the views, clicks and purchases of a user.
MATCH = """
WITH e AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')),
r AS (SELECT *, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER w AS run FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT user_id, run, min_by(event_type, struct(ts, event_id)) AS head, min(CASE WHEN event_type <> 'click' THEN event_id END) AS head_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks FROM r GROUP BY user_id, run),
n AS (SELECT user_id, head, head_id, clicks, lead(head) OVER w AS next_head, lead(head_id) OVER w AS next_id FROM g WINDOW w AS (PARTITION BY user_id ORDER BY run))
SELECT user_id, head_id AS first_id, clicks, next_id AS last_id FROM n WHERE head = 'view' AND clicks > 0 AND next_head = 'purchase'
"""
MATCH_ORACLE = """
WITH e AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' ELSE 'p' END, '' ORDER BY ts, event_id) AS s FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id),
p AS (SELECT user_id, ids, s, unnest(range(1, len(s) + 1)) AS i FROM e)
SELECT user_id, ids[i] AS first_id, len(regexp_extract(s[i:], '^vc+p')) - 2 AS clicks, ids[i + len(regexp_extract(s[i:], '^vc+p')) - 1] AS last_id FROM p WHERE regexp_matches(s[i:], '^vc+p')
"""
HIERARCHY = "WITH RECURSIVE edges(k, parent) AS (SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier), t(k, lvl, root) AS (SELECT concat('r', r_regionkey), 1, concat('r', r_regionkey) FROM region UNION ALL SELECT e.k, lvl + 1, root FROM t JOIN edges e ON e.parent = t.k) SELECT k, lvl, root FROM t"

SQL: dict[str, tuple[str | Callable[[SparkSession, str], DataFrame], str]] = {
    "file_reference": (file_reference, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "sample_rows": ("SELECT count(*) AS n FROM (SELECT * FROM orders TABLESAMPLE (50 ROWS))", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 50)"),
    "sample_repeatable": ("SELECT a.n = b.n AS same, a.n BETWEEN c.n * 0.05 AND c.n * 0.15 AS near FROM (SELECT count(*) AS n FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (42)) a, (SELECT count(*) AS n FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (42)) b, (SELECT count(*) AS n FROM orders) c", "SELECT count(*) = count(o_orderkey) AS same, count(*) > 0 AS near FROM orders"),
    "time_travel": (time_travel, "SELECT k, v FROM (SELECT user_id AS k, round(value, 2) AS v, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-03 12:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"),
    "join_hints": ("SELECT /*+ BROADCAST(n), SHUFFLE_HASH(c) */ n_name, count(*) AS n FROM customer c JOIN nation n ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "join_all_strictness": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 20 * c_acctbal)", "SELECT c_custkey FROM customer WHERE 20 * c_acctbal > ALL (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey)"),
    "cross_apply": ("SELECT n_nationkey, c_custkey FROM nation CROSS JOIN LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)", "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000"),
    "table_function": ("SELECT id * 2 AS x FROM range(3, 9)", "SELECT range * 2 AS x FROM range(3, 9)"),
    "unnest_with_position": ("SELECT r_regionkey, pos, x FROM region, LATERAL posexplode(array(r_regionkey, r_regionkey * 10)) AS t(pos, x)", "SELECT r_regionkey, CAST(i - 1 AS INTEGER) AS pos, [r_regionkey, r_regionkey * 10][i] AS x FROM region, range(1, 3) AS t(i)"),
    "approximate_aggregates": ("SELECT o_orderstatus, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.15 * count(DISTINCT o_custkey) AS near, abs(approx_percentile(o_totalprice, 0.5, 1000) - percentile(o_totalprice, 0.5)) <= 0.02 * percentile(o_totalprice, 0.5) AS median_near FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) > 0 AS near, count(*) > 0 AS median_near FROM orders GROUP BY o_orderstatus"),
    "fetch_first": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 3 ROWS FETCH FIRST 10 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 3"),
    "limit_pair": ("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 4, 6", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 6 OFFSET 4"),
    "limit_all": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT ALL", "SELECT n_nationkey FROM nation"),
    "top_rows": ("SELECT TOP 7 c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7"),
    "top_percent": (top_percent, "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= ceil((SELECT count(*) FROM orders) / 10)"),
    "qualify_clause": ("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0 QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) <= 2", "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0 QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) <= 2"),
    "window_distribution": (window_distribution, "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_suppkey) AS q, round(percent_rank() OVER (ORDER BY s_suppkey), 6) AS pr, round(cume_dist() OVER (ORDER BY s_suppkey), 6) AS cd FROM supplier"),
    "window_exclude_group": ("SELECT p_partkey, sum(p_size) OVER b - sum(p_size) OVER g AS rest, sum(p_size) OVER b - sum(p_size) OVER g + p_size AS ties FROM part WINDOW b AS (PARTITION BY p_brand), g AS (PARTITION BY p_brand, p_type)", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand) - sum(p_size) OVER (PARTITION BY p_brand, p_type) AS rest, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS ties FROM part"),
    "window_respect_nulls": ("SELECT event_id, first_value(nullif(event_type, 'click')) RESPECT NULLS OVER w AS a, nth_value(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "SELECT event_id, first_value(nullif(event_type, 'click')) OVER w AS a, nth_value(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "set_minus": ("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000 MINUS SELECT o_custkey FROM orders WHERE o_totalprice > 300000", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000"),
    "union_by_name": (union_by_name, "SELECT n_nationkey AS k, n_name AS name, NULL::INTEGER AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, length(r_name) FROM region"),
    "connect_by_prior": (HIERARCHY, HIERARCHY),
    "match_recognize": (MATCH, MATCH_ORACLE),
    "transform_script": ("SELECT CAST(k AS INT) AS k, name FROM (SELECT TRANSFORM(n_nationkey, n_name) ROW FORMAT DELIMITED FIELDS TERMINATED BY ',' USING 'cat' AS (k, name) ROW FORMAT DELIMITED FIELDS TERMINATED BY ',' FROM nation)", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "pipe_syntax": ("FROM orders |> WHERE o_totalprice > 100000 |> EXTEND year(o_orderdate) AS y |> AGGREGATE count(*) AS n GROUP BY y |> WHERE n > 1", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING count(*) > 1"),
    "like_escape": ("SELECT p_partkey, p_brand || '_x' LIKE 'Brand#1%!_x' ESCAPE '!' AS yes FROM part", "SELECT p_partkey, p_brand || '_x' LIKE 'Brand#1%!_x' ESCAPE '!' AS yes FROM part"),
    "nan_and_truth": ("SELECT s_suppkey, isnan(CASE WHEN s_acctbal < 0 THEN double('NaN') ELSE s_acctbal END) AS nan, (s_acctbal > 0) IS TRUE AS t, nullif(s_nationkey, 3) > 5 IS NOT FALSE AS f FROM supplier", "SELECT s_suppkey, isnan(CASE WHEN s_acctbal < 0 THEN 'NaN'::DOUBLE ELSE s_acctbal END) AS nan, (s_acctbal > 0) IS TRUE AS t, (nullif(s_nationkey, 3) > 5) IS DISTINCT FROM FALSE AS f FROM supplier"),
    "shift_xor_sign": ("SELECT p_partkey, p_size ^ 5 AS x, p_size >> 1 AS r, p_size << 2 AS l, ~p_size AS inv, -p_size AS neg, +p_size AS pos, CAST(sign(p_size - 25) AS INT) AS s FROM part", "SELECT p_partkey, xor(p_size, 5) AS x, p_size >> 1 AS r, p_size << 2 AS l, ~p_size AS inv, -p_size AS neg, +p_size AS pos, CAST(sign(p_size - 25) AS INTEGER) AS s FROM part"),
    "cast_shorthand": ("SELECT o_orderkey::string AS s, o_totalprice::int AS i, o_orderdate::date::string AS d, try_cast(o_orderstatus AS INT) AS t FROM orders", "SELECT o_orderkey::VARCHAR AS s, CAST(trunc(o_totalprice) AS INTEGER) AS i, o_orderdate::DATE::VARCHAR AS d, try_cast(o_orderstatus AS INTEGER) AS t FROM orders"),
    "date_units": ("SELECT o_orderkey, dateadd(MONTH, 1, o_orderdate) AS m, timestampadd(HOUR, -5, o_orderdate) AS h, datediff(DAY, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS d, CAST(last_day(o_orderdate) AS STRING) AS l FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 5 HOUR AS h, datediff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS d, CAST(last_day(o_orderdate) AS VARCHAR) AS l FROM orders"),
    "bare_functions": ("SELECT n_nationkey, current_date = to_date(current_timestamp) AS d, current_timestamp = now() AS t, current_user IS NOT NULL AS u FROM nation", "SELECT n_nationkey, current_date = CAST(now() AT TIME ZONE 'UTC' AS DATE) AS d, current_timestamp = now() AS t, current_user IS NOT NULL AS u FROM nation"),
    "nested_values": ("SELECT n_nationkey, array(1, n_nationkey, 3)[1] AS a, array_join(slice(array(1, n_nationkey, 3), 2, 2), ',') AS s, named_struct('x', n_name, 'y', 2).x AS f, map('k', n_regionkey)['k'] AS m, size(array()) AS z FROM nation", "SELECT n_nationkey, [1, n_nationkey, 3][2] AS a, array_to_string([1, n_nationkey, 3][2:3], ',') AS s, {'x': n_name, 'y': 2}.x AS f, MAP {'k': n_regionkey}['k'] AS m, len([]) :: INTEGER AS z FROM nation"),
    "json_path": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k AS j, try_variant_get(parse_json(props), '$.k', 'int') AS v FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS INTEGER) AS j, CAST(props::JSON ->> 'k' AS INTEGER) AS v FROM events"),
    "collations": ("SELECT n_nationkey, n_name COLLATE UTF8_LCASE = 'france' AS f, contains(n_name COLLATE UTF8_LCASE, 'an') AS c FROM nation", "SELECT n_nationkey, n_name COLLATE NOCASE = 'france' AS f, contains(lower(n_name), 'an') AS c FROM nation"),
    "time_zones": ("SELECT event_id, convert_timezone('UTC', 'Europe/Berlin', to_timestamp_ntz(ts)) AS berlin, hour(from_utc_timestamp(ts, 'Asia/Tokyo')) AS tokyo FROM events", "SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin' AS berlin, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo') AS tokyo FROM events"),
    "apply_changes": (apply_changes, "WITH n AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT k, v FROM n WHERE s <> 'F' UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM n)"),
    "merge_tables": (merge_tables, "WITH s AS (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1 UNION ALL SELECT -1 - r_regionkey, r_regionkey FROM region) SELECT k, v FROM s UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM s) EXCEPT ALL SELECT k, v FROM s WHERE v < 100000 AND k IN (SELECT c_custkey FROM customer)"),
    "update_rows": (update_rows, "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part"),
    "delete_rows": (delete_rows, "SELECT p_partkey, p_size FROM part WHERE NOT coalesce(nullif(p_size, 7) > 10, false)"),
    "insert_rows": (insert_rows, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation"),
    "sliding_window": ("SELECT window.start AS w, count(*) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')", "SELECT w, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w"),
    "session_window": ("SELECT user_id, session_window.start AS s, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '10 minutes')", "SELECT user_id, min(ts) AS s, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL 10 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, g"),
}


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    how = SQL[name][0]
    if callable(how):
        return how

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, how)
        return spark.sql(rewriting.rewritten(how))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(name) for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: duck for name, (_, duck) in SQL.items()}
