"""Changes of tables, ranks over ranges, and clauses that are rewritten."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import changes, ranking, rewriting


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_with_nulls_and_repeated_rows(spark):
    old = spark.createDataFrame([(1, 10), (2, 20), (None, 30), (2, 21)], "k int, v int")
    new = spark.createDataFrame([(2, 5), (3, 6), (None, 7)], "k int, v int")
    got = changes.merge(old, new, ["k"], update={"v": F.col("target.v") + F.col("source.v")}, delete=F.col("target.v") == 21, insert={"k": F.col("source.k"), "v": F.col("source.v")})
    assert rows(got) == sorted([(1, 10), (2, 25), (None, 30), (3, 6), (None, 7)], key=repr)
    assert rows(changes.merge(old, new, ["k"], update={"v": F.lit(0)})) == sorted([(1, 10), (2, 0), (2, 0), (None, 30)], key=repr)
    with pytest.raises(changes.Ambiguous):
        changes.merge(old, new.unionByName(new), ["k"], update={"v": F.lit(0)}, check=True)
    assert rows(changes.merge(old.limit(0), new, ["k"], insert={"k": F.col("source.k")})) == sorted([(2, None), (3, None), (None, None)], key=repr)


def test_insert_update_delete(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert rows(changes.update(t, {"s": F.upper("s")}, F.col("s") == "a")) == [(1, "A"), (2, None)]
    assert rows(changes.delete(t, F.col("s") == "a")) == [(2, None)]
    assert rows(changes.insert(t, spark.createDataFrame([("z",)], "s string"))) == sorted([(1, "a"), (2, None), (None, "z")], key=repr)
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 3, "d", True)], "k int, v int, s string, gone boolean")
    assert rows(changes.as_of(log, ["k"], "v", F.col("v") <= 2, "gone").select("k", "s")) == [(1, "b"), (2, "c")]
    assert rows(changes.as_of(log, ["k"], "v", F.lit(True), "gone").select("k", "s")) == [(1, "b")]


@pytest.mark.parametrize("size", [10, 3])
def test_ranks_over_ranges(spark, size):
    rng = random.Random(size)
    keys = [rng.randint(0, 40) for _ in range(500)]
    got = sorted((r["rank"], r["k"]) for r in ranking.ranked(spark.createDataFrame([(k,) for k in keys], "k int"), "k", "rank", size).collect())
    assert got == list(enumerate(sorted(keys), 1))
    assert ranking.ranked(spark.createDataFrame([], "k int"), "k", "rank").count() == 0


def test_rewriting():
    f = rewriting.rewritten
    assert f("SELECT a FROM t ORDER BY a FETCH FIRST 3 ROWS ONLY") == "SELECT a FROM t ORDER BY a LIMIT 3"
    assert f("SELECT a FROM t OFFSET 2 ROWS FETCH NEXT ROW ONLY") == "SELECT a FROM t LIMIT 1 OFFSET 2"
    assert f("SELECT TOP (5) a FROM t") == "SELECT a FROM t LIMIT 5"
    assert f("SELECT a FROM t LIMIT 2, 9") == "SELECT a FROM t LIMIT 9 OFFSET 2"
    assert f("SELECT a FROM (SELECT b FROM u LIMIT 1, 2) x") == "SELECT a FROM (SELECT b FROM u LIMIT 1, 2) x"
    assert "WHERE __qualify ORDER BY a LIMIT 3" in f("SELECT a FROM t QUALIFY rank() OVER (ORDER BY a) = 1 ORDER BY a LIMIT 3")
    with pytest.raises(ValueError):
        f("SELECT TOP 5 PERCENT a FROM t")
