"""INSERT, UPDATE, DELETE, MERGE and VERSION AS OF over DataFrames: each gives the table as it is afterwards.

Parquet files don't change in place; a caller writes the result to a new folder and moves the name of the table to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns go by name; those that ``rows`` lacks are null."""
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def update(target: DataFrame, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which the condition is null stay."""
    return target.where(F.lit(False) if where is None else ~F.coalesce(where, F.lit(False)))


class Ambiguous(ValueError):
    pass


def merge(target: DataFrame, source: DataFrame, on: list[str], update: dict[str, Column] | None = None, delete: Column | None = None, insert: dict[str, Column] | None = None, check: bool = False) -> DataFrame:
    """MERGE INTO: rows that match on ``on`` are deleted where ``delete`` holds, else updated; source rows without a match
    are inserted. Expressions name columns as ``target.x`` and ``source.x``. With ``check``, a target row that several
    source rows match raises ``Ambiguous``, for the price of one more aggregation."""
    if check and source.groupBy(*on).count().where("count > 1").join(target.select(*on), on, "left_semi").limit(1).count():
        raise Ambiguous(f"several source rows match on {', '.join(on)}")
    t, s = target.withColumn("__t", F.lit(True)).alias("target"), source.withColumn("__s", F.lit(True)).alias("source")
    both = t.join(s, reduce(lambda a, b: a & b, [F.col(f"target.{c}") == F.col(f"source.{c}") for c in on]), "full_outer" if insert else "left")
    matched, fresh = F.col("__t").isNotNull() & F.col("__s").isNotNull(), F.col("__t").isNull()
    if delete is not None:
        both = both.where(~(matched & F.coalesce(delete, F.lit(False))))
    out = []
    for c in target.columns:
        value = F.when(matched, (update or {}).get(c, F.col(f"target.{c}")))
        if insert:
            value = value.when(fresh, insert.get(c, F.lit(None)))
        out.append(value.otherwise(F.col(f"target.{c}")).cast(target.schema[c].dataType).alias(c))
    return both.select(*out)


def as_of(log: DataFrame, keys: list[str], version: str, upto: Column, gone: str | None = None) -> DataFrame:
    """The table that a log of changes made up to a moment: the last row of each key, without keys whose last row says
    ``gone``. One aggregation with a partial step on the map side, so a hot key costs no sort."""
    rest = [c for c in log.columns if c not in keys and c != version]
    last = log.where(upto).groupBy(*keys).agg(F.max_by(F.struct(version, *rest), F.col(version)).alias("__last"))
    out = last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in [version, *rest]])
    return out.where(~F.coalesce(F.col(gone), F.lit(False))).drop(gone) if gone else out
