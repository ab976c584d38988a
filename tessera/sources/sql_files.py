"""SQL files as rows: (path, source)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ignore import Ignore

EXTENSIONS = (".sql", ".sql.j2", ".dml", ".ddl")


def _glob(extensions: tuple[str, ...]) -> str:
    """The extensions in any case, for the listing itself: files of other kinds aren't opened."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def listed(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length) of the files below ``path`` with one of the extensions; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions)).load(path).select("path", "length")


def read(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, ignore: tuple[str, ...] = (), ignore_file: str | None = None) -> DataFrame:
    """Files below ``path`` with one of the extensions, whatever their case. ``ignore`` has regular expressions of paths to
    skip; ``ignore_file`` is the text of an ignore file that holds from ``path`` down. What is skipped isn't opened."""
    names = [path]
    if ignore or ignore_file:
        found = listed(spark, path, extensions)
        for pattern in ignore:
            found = found.where(~F.col("path").rlike(pattern))
        if ignore_file:
            root = spark._jvm.org.apache.hadoop.fs.Path(path)
            top = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
            skip = Ignore(ignore_file)

            def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array([not skip(p.removeprefix(top).removeprefix(top.replace("file:/", "file:///"))) for p in batch.column(0).to_pylist()], pa.bool_()))

            found = found.mapInArrow(kept, found.schema)
        # names alone, which the driver's own listing holds anyway
        names = [r["path"] for r in found.select("path").toLocalIterator()]
        if not names:
            return spark.createDataFrame([], "path string, source string")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions)).text(names, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))
    return normalised(files)


def normalised(files: DataFrame) -> DataFrame:
    return files.withColumn("source", F.regexp_replace("source", "\r\n|\r", "\n"))


def strings(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(sources.items()), "path string, source string")


def standard_input(spark: SparkSession, stream: TextIO | None = None) -> DataFrame:
    """One document from standard input, as the path ``-``."""
    return normalised(strings(spark, {"-": (stream or sys.stdin).read()}))


def write_back(spark: SparkSession, fixed: DataFrame) -> int:
    """Writes (path, source, changed) to the paths where ``changed`` is set, through the file system of each path; gives
    their number. Rows come to the driver one partition at a time, and only those that changed."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for r in fixed.where(F.col("changed").cast("int") == 1).select("path", "source").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(r["path"])
        out = at.getFileSystem(conf).create(at, True)
        try:
            out.write(bytearray(r["source"].encode("utf-8")))
        finally:
            out.close()
        n += 1
    return n
