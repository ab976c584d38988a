"""Shared helpers: table access, lineage cuts in the shared checkpoint folder, skew-proof ranks."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The six ASCII white-space characters that end a word, as in ``[^\x20\x09-\x0D]+``; bytes.split() uses the same set.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: A Python worker takes rows together up to so many bytes.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local session without the setting."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Spark's own setting for the bytes of a batch that it sends to a Python worker.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared checkpoint folder, so that a lost executor costs no recomputation.

    Meanwhile Spark sends Python workers batches of at most ``BATCH_BYTES``: its writer, the stream and the worker each
    hold a batch, for all tasks of an executor. Only batches differ, not rows.
    """
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(ARROW_BYTES)
    conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(ARROW_BYTES, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, salts: int = 256) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 within ``keys``, without gathering a key's rows in one task.

    Rows of a key are dealt over ``salts`` buckets by the hash of ``order``; each bucket is ranked alone and shifted by
    the rows of the buckets before it. Rows that tie in all of ``order`` get ranks in any order.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = salted.withColumn("__at", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order)) - 1)
    joined = local.join(sizes.select(*[F.col(k).alias(f"__r_{k}") for k in [*keys, "__salt"]], "__before"),
                        [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in [*keys, "__salt"]], "left")
    return joined.select(*df.columns, (F.col("__at") + F.col("__before")).cast("long").alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once for a row: the optimizer would repeat it at each use, in a lambda even
    for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of at most ``BATCH_BYTES`` or of one row, so that what a worker makes of
    a batch is bounded."""
    for batch in batches:
        rest = [batch]
        while rest:
            x = rest.pop()
            if x.num_rows > 1 and x.nbytes > BATCH_BYTES:
                half = x.num_rows // 2
                rest += [x.slice(half), x.slice(0, half)]
            else:
                yield x
