"""The editor's loop as streams: documents that arrive are linted, and the latest diagnostics of each path are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lint

SCHEMA = "path string, source string, version long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of documents as they are written to a folder of Parquet files."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def diagnose(files: DataFrame, rules: str = "core", dialect: str = "ansi") -> DataFrame:
    """Violations of each document; no state is needed, so it runs on a stream as it does on a table."""
    return lint.violations(files, rules, dialect=dialect)


def keep_latest(files: DataFrame, target: str, checkpoint: str, rules: str = "core", dialect: str = "ansi") -> StreamingQuery:
    """Appends to ``target`` (path, version, diagnostics) for the newest version of each path in a batch.

    A batch that runs again after a failure overwrites its own folder, so that its rows stand there once.
    """

    def write(batch: DataFrame, n: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("source", "version").alias("source"), F.max("version").alias("version")).cache()
        found = lint.as_json(lint.violations(newest, rules, dialect=dialect))
        newest.select("path", "version").join(found, "path", "left").select("path", "version", F.coalesce("diagnostics", F.lit("[]")).alias("diagnostics")).write.mode("overwrite").parquet(f"{target}/batch={n}")
        newest.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """(path, version, diagnostics): the state of each path over all batches."""
    return spark.read.parquet(target).groupBy("path").agg(F.max("version").alias("version"), F.max_by("diagnostics", F.struct("version", "batch")).alias("diagnostics"))


def apply_changes(target: DataFrame, changes: DataFrame, key: str, sequence: str, deleted: str) -> DataFrame:
    """``target`` after keyed changes: the change with the highest sequence wins, and a row it marks as deleted goes."""
    rest = [c for c in target.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*rest, F.col(deleted).alias("__gone")), sequence).alias("__new"))
    kept = target.join(newest.select(key), key, "left_anti").select(key, *rest)
    return kept.unionByName(newest.where(~F.col("__new.__gone")).select(key, *[F.col(f"__new.{c}").alias(c) for c in rest]))
