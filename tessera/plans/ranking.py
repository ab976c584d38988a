"""Ranks over all rows of a table, by ranges of the key instead of one window for everything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one range, about.
RANGE_ROWS = 1_000_000
#: Ranges at most: their bounds and counts come to the driver.
RANGES = 10_000


def ranked(df: DataFrame, key: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``name``: the place of each row in the order of the numeric column ``key``, from 1; equal keys in any order.

    Bounds come from approximate quantiles and cut the rows into ranges; each range is ranked alone and shifted by the
    rows of the ranges before it. The bounds are constants, so a task that runs again finds the same ranges.
    """
    n = df.count()
    parts = max(1, min(RANGES, -(-n // range_rows)))
    bounds = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    spark = df.sparkSession
    if bounds:
        found = F.array(*map(F.lit, bounds))
        # the number of bounds below the key
        bucket = F.size(F.filter(found, lambda b: b < F.col(key))) if len(bounds) <= 64 else reduce(lambda a, b: a + b, [F.size(F.filter(F.slice(found, i + 1, 64), lambda b: b < F.col(key))) for i in range(0, len(bounds), 64)])
        df = df.withColumn("__range", bucket)
    else:
        df = df.withColumn("__range", F.lit(0))
    counts = {r["__range"]: r["n"] for r in df.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = 0, []
    for r in sorted(counts):
        rows.append((r, before))
        before += counts[r]
    shifts = spark.createDataFrame(rows, "__range int, __before long")
    local = df.withColumn(name, F.row_number().over(W.partitionBy("__range").orderBy(key)))
    return local.join(F.broadcast(shifts), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")
