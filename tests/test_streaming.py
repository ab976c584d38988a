from datetime import datetime

from pyspark.sql import functions as F

from tessera.streaming import lint_job, streams


def test_latest_diagnostics(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(rows, lint_job.SCHEMA).coalesce(1).write.mode("append").parquet(docs)
        lint_job.keep_latest(lint_job.read(spark, docs), out, str(tmp_path / "state")).awaitTermination(60)

    arrive(("a", "SELECT count(1)\n", 1), ("b", "SELECT 1\n", 1))
    got = {r["path"]: r for r in lint_job.latest(spark, out).collect()}
    assert "CV04" in got["a"]["diagnostics"] and got["b"]["diagnostics"] == "[]"
    arrive(("a", "SELECT count(*)\n", 2))
    got = {r["path"]: r for r in lint_job.latest(spark, out).collect()}
    assert got["a"]["version"] == 2 and got["a"]["diagnostics"] == "[]"


def test_apply_changes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", 1, False), (1, "y", 2, False), (2, "b", 3, True), (4, "d", 1, False), (5, "e", 1, False), (5, "e", 2, True)], "k int, v string, seq int, gone boolean")
    assert {tuple(r) for r in lint_job.apply_changes(target, changes, "k", "seq", "gone").collect()} == {(1, "y"), (3, "c"), (4, "d")}


EVENTS = "k string, at timestamp, v long"


def arrived(spark, folder, *rows):
    spark.createDataFrame([(k, datetime.fromisoformat(at), v) for k, at, v in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_tasks_see_each_change_once(spark, tmp_path):
    table, seen = str(tmp_path / "t"), []
    run = lambda: streams.task(streams.change_stream(spark, table, EVENTS), lambda b, n: seen.append((n, sorted(r["v"] for r in b.collect()))), str(tmp_path / "c"), when=lambda b: b.count() > 0).awaitTermination(60)
    arrived(spark, table, ("a", "2024-01-01T00:00:00", 1), ("b", "2024-01-01T00:01:00", 2))
    run()
    run()
    arrived(spark, table, ("a", "2024-01-01T00:02:00", 3))
    run()
    assert [x for _, x in seen] == [[1, 2], [3]]


def test_refreshed_view(spark, tmp_path):
    table, target = str(tmp_path / "t"), str(tmp_path / "v")

    def refresh():
        streams.refreshed_view(streams.change_stream(spark, table, EVENTS), "at", "1 hour", [F.window("at", "10 minutes").alias("w"), F.col("k")], {"n": F.count(F.lit(1)), "s": F.sum("v")}, target, str(tmp_path / "c")).awaitTermination(90)
        return {(r["k"], r["w"]["start"].hour, r["w"]["start"].minute): (r["n"], r["s"]) for r in streams.view(spark, target, ["w", "k"]).collect()}

    arrived(spark, table, ("a", "2024-01-01T00:01:00", 1), ("a", "2024-01-01T00:12:00", 2))
    assert refresh() == {("a", 0, 0): (1, 1), ("a", 0, 10): (1, 2)}
    arrived(spark, table, ("a", "2024-01-01T00:02:00", 5), ("b", "2024-01-01T05:00:00", 7))
    assert refresh() == {("a", 0, 0): (2, 6), ("a", 0, 10): (1, 2), ("b", 5, 0): (1, 7)}
    arrived(spark, table, ("a", "2024-01-01T00:03:00", 9))  # behind the watermark by now
    assert refresh() == {("a", 0, 0): (2, 6), ("a", 0, 10): (1, 2), ("b", 5, 0): (1, 7)}


def test_subscription_and_messages(spark, tmp_path):
    table, got = str(tmp_path / "t"), []
    arrived(spark, table, ("a", "2024-01-01T00:01:00", 1))
    streams.subscribe(streams.change_stream(spark, table, EVENTS).where("v > 0"), lambda b, n: got.extend(b.collect()), str(tmp_path / "c")).awaitTermination(60)
    assert [r["v"] for r in got] == [1]
    rows = spark.createDataFrame([("a", 1)], "k string, v long")
    sent = streams._encoded(rows, "k").selectExpr("CAST(key AS BINARY) AS key", "CAST(value AS BINARY) AS value", "TIMESTAMP '2024-01-01 00:00:00' AS timestamp")
    assert [(r["key"], r["k"], r["v"]) for r in streams._decoded(sent, "k string, v long").collect()] == [("a", "a", 1)]
    assert streams._decoded(sent, None).columns == ["key", "value", "timestamp"]
    assert streams.kafka_options("h:1", "t") == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest"}
    assert streams.kafka_options("h:1", "t", True)["topic"] == "t"
