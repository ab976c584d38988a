import pytest

from tessera.operators import analysis as A
from tessera.sources.sql_files import strings


def leaves(sql, schema=None, views=None):
    return {(r[0], r[3]) for r in A.lineage_rows(sql, schema, views) if r[6]}


def test_lineage_through_ctes_stars_and_unions():
    schema = {"t": ["a", "b"], "u": ["c"]}
    assert leaves("SELECT * FROM (SELECT a, b AS x FROM t) q", schema) == {("a", "t.a"), ("x", "t.b")}
    assert leaves("WITH w AS (SELECT a + b AS s FROM t) SELECT s, c FROM w, u", schema) == {("s", "t.a"), ("s", "t.b"), ("c", "u.c")}
    assert leaves("SELECT a FROM t UNION SELECT c FROM u", schema) == {("a", "t.a"), ("a", "u.c")}
    assert leaves("WITH RECURSIVE r(n) AS (SELECT a FROM t UNION ALL SELECT n + 1 FROM r) SELECT n FROM r", schema) == {("n", "t.a")}
    assert leaves("SELECT y.a FROM y", schema, {"y": "SELECT max(a) AS a FROM t"}) == {("a", "t.a")}
    assert leaves("SELECT (SELECT max(c) FROM u WHERE u.c = t.a) AS m FROM t", schema) == {("m", "u.c")}
    assert leaves("SELECT a.x FROM s.t AS a") == {("x", "a.x")}


def test_a_source_that_reads_itself_ends():
    assert A.lineage_rows("SELECT a FROM v", None, {"v": "SELECT a FROM v"})


def test_output_columns():
    assert A.output_columns("SELECT a, b + 1, c AS d, count(*) FROM t") == (["a", "d"], ["b + 1", "count(*)"])
    with pytest.raises(ValueError):
        A.output_columns("SELECT FROM (")


def given(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], A.TEST_SCHEMA)


def test_inference(spark):
    sources = given(spark, ("unique", "t", "a"), ("not_null", "t", "b"), ("greater_than", "t", "b", "3"), ("not_null", "u", "c"))
    cases = {
        "pass": ("SELECT a AS x FROM t", {("unique", "x")}), "inner": ("SELECT t.a, u.c FROM t JOIN u ON t.a = u.c", {("unique", "a"), ("not_null", "c")}),
        "left": ("SELECT t.a, u.c FROM t LEFT JOIN u ON t.a = u.c", {("unique", "a")}), "right": ("SELECT t.a FROM t RIGHT JOIN u ON t.a = u.c", set()),
        "agg": ("SELECT a, max(b) AS m FROM t GROUP BY a", {("unique", "a"), ("not_null", "m"), ("greater_than", "m")}), "whole": ("SELECT max(b) AS m FROM t", {("greater_than", "m")}),
        "count": ("SELECT count(*) AS n FROM t", {("not_null", "n"), ("greater_than_or_equal", "n")}), "star": ("SELECT * FROM t", {("unique", "a"), ("not_null", "b"), ("greater_than", "b")}),
        "cte": ("WITH w AS (SELECT b AS z FROM t) SELECT z AS y FROM w", {("not_null", "y"), ("greater_than", "y")}), "none": ("SELECT b + 1 AS b FROM t", set()), "bad": ("SELECT (", set()),
    }
    got = A.infer(strings(spark, {k: v[0] for k, v in cases.items()}), sources).collect()
    for name, (_, want) in cases.items():
        assert {(r["kind"], r["column"]) for r in got if r["path"] == name} == want, name


def test_skips_what_is_implied(spark):
    got = {(r["kind"], r["path"], r["column"]): r["action"] for r in A.skippable(strings(spark, A.SAMPLE), spark.createDataFrame(A.TESTS, A.TEST_SCHEMA)).collect()}
    assert got["not_null", "per_customer", "customer"] == got["greater_than", "per_customer", "top"] == "skip"
    assert got["unique", "per_customer", "customer"] == got["unique", "orders", "o_orderkey"] == "run"


def test_tree_table(spark):
    nodes = A.trees(strings(spark, {"x": "SELECT a, (SELECT b FROM u) FROM t\n"}))
    inner = A.descendants(nodes, ["select"], ["column_ref"], ("query",)).collect()
    assert len(inner) == 2 and A.descendants(nodes, ["select"], ["column_ref"]).count() == 3


QUALIFY = [
    ("SELECT a FROM t", "SELECT t.a AS a FROM t AS t"), ("SELECT * FROM t JOIN u ON b = c", "SELECT t.a AS a, t.b AS b, u.c AS c, u.d AS d FROM t AS t JOIN u AS u ON t.b = u.c"),
    ("SELECT x.* FROM t AS x, (SELECT c FROM u)", "SELECT x.a AS a, x.b AS b FROM t AS x, (SELECT u.c AS c FROM u AS u) AS _q_0"), ("SELECT a + 1, b FROM t ORDER BY b", "SELECT t.a + 1 AS _col_0, t.b AS b FROM t AS t ORDER BY t.b"),
    ("SELECT a AS z FROM t GROUP BY z HAVING z > 1", "SELECT t.a AS z FROM t AS t GROUP BY z HAVING z > 1"), ("SELECT m FROM v", "SELECT v.m AS m FROM (SELECT t.a AS m FROM t AS t) AS v"), ("SELECT q.a FROM t q JOIN unknown w ON q.a = w.k", "SELECT q.a AS a FROM t q JOIN unknown w ON q.a = w.k"),
    ("WITH c AS (SELECT a, b FROM t) SELECT * FROM c", "WITH c AS (SELECT t.a AS a, t.b AS b FROM t AS t) SELECT c.a AS a, c.b AS b FROM c AS c"), ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE d = a)", "SELECT t.a AS a FROM t AS t WHERE EXISTS (SELECT 1 AS _col_0 FROM u AS u WHERE u.d = a)"),
    ("SELECT s.x.a FROM s.x", "SELECT s.x.a AS a FROM s.x AS x"),
]


@pytest.mark.parametrize(("sql", "want"), QUALIFY)
def test_qualification(sql, want):
    got = A.qualified(sql, {"t": ["a", "b"], "u": ["c", "d"]}, {"v": "SELECT a AS m FROM t"})
    assert got["qualify_outputs"] == want
    assert A.qualified(want, {"t": ["a", "b"], "u": ["c", "d"]})["qualify_outputs"] == want


def test_scopes():
    rows = A.scope_rows("WITH c AS (SELECT a FROM t) SELECT a FROM c UNION ALL SELECT x FROM (SELECT x FROM u) AS d WHERE EXISTS (SELECT 1 FROM w)")
    assert [r[1] for r in rows if r[4] == 0] == ["cte", "set_expression", "set_expression", "derived", "subquery"]
    assert [r[2] for r in rows if r[4]] == ["t", "c", "d", "u", "w"]
