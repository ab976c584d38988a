"""Streaming objects of the dialects on Structured Streaming: streams of changes, tasks, refreshed views, subscriptions, Kafka."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def change_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """CREATE STREAM: the rows that are appended to a table, each once for a reader with a checkpoint of its own."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def task(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, when: Callable[[DataFrame], bool] = lambda _: True, every: str | None = None) -> StreamingQuery:
    """CREATE TASK: ``run(batch, number)`` over what has arrived since the last run, if ``when`` holds for it; ``every`` as in
    "5 minutes", else once over all there is. A batch that failed comes again with its number, so ``run`` should write
    under it."""

    def once(batch: DataFrame, number: int) -> None:
        if when(batch):
            run(batch, number)

    writer = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def refreshed_view(stream: DataFrame, time: str, late: str, keys: list[Column], sums: dict[str, Column], target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """CREATE MATERIALIZED VIEW ... REFRESH: aggregates by ``keys`` kept up to date; rows more than ``late`` behind are
    dropped with their state. Changed groups are appended under the number of their batch; ``view`` reads the newest."""
    grouped = stream.withWatermark(time, late).groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = grouped.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def view(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The newest row of each group of a refreshed view."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("__row"))
    return newest.select(*keys, "__row.*")


def subscribe(stream: DataFrame, on_rows: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """SUBSCRIBE: each change of a result goes to ``on_rows`` with the number of its batch."""
    return stream.writeStream.outputMode(mode).foreachBatch(on_rows).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kafka_options(servers: str, topic: str, sink: bool = False, **options: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic" if sink else "subscribe": topic, **({} if sink else {"startingOffsets": "earliest"}), **options}


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str | None = None, **options: str) -> DataFrame:
    """CREATE SOURCE FROM KAFKA: keys, values (as ``schema`` from JSON, if given) and times; needs Spark's Kafka connector."""
    rows = spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load()
    return _decoded(rows, schema)


def _decoded(rows: DataFrame, schema: str | None) -> DataFrame:
    key, value = F.col("key").cast("string").alias("key"), F.col("value").cast("string")
    if schema is None:
        return rows.select(key, value.alias("value"), "timestamp")
    return rows.select(key, F.from_json(value, schema).alias("__v"), "timestamp").select("key", "__v.*", "timestamp")


def _encoded(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def kafka_sink(rows: DataFrame, servers: str, topic: str, key: str, checkpoint: str, **options: str) -> StreamingQuery:
    """CREATE SINK INTO KAFKA: each row as JSON under its key."""
    return _encoded(rows, key).writeStream.format("kafka").options(**kafka_options(servers, topic, True, **options)).option("checkpointLocation", checkpoint).start()
