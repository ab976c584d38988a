"""The eight column assertions as operators that return the violating values. All but NotNull ignore nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of each value that stands more than once."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def relationship(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    # the targets are made unique on the map side first, so a hot target key costs nothing
    keys = target.select(F.col(target_column).alias("__target")).where("__target IS NOT NULL").distinct()
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__target"), "left_anti")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values))


def _compared(df: DataFrame, ok: Column) -> DataFrame:
    return df.where(~ok)


def greater_than_or_equal(df: DataFrame, column: str, value) -> DataFrame:
    return _compared(df, F.col(column) >= value)


def greater_than(df: DataFrame, column: str, value) -> DataFrame:
    return _compared(df, F.col(column) > value)


def less_than_or_equal(df: DataFrame, column: str, value) -> DataFrame:
    return _compared(df, F.col(column) <= value)


def less_than(df: DataFrame, column: str, value) -> DataFrame:
    return _compared(df, F.col(column) < value)


def _of(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        t = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet")
        o, li = t("orders"), t("lineitem")
        return {
            "test_not_null": lambda: not_null(o.withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P"))), "status").select("o_orderkey"),
            "test_unique": lambda: unique(o, "o_custkey"),
            "test_relationship": lambda: relationship(t("customer"), "c_custkey", o.where("o_orderstatus = 'P'"), "o_custkey").select("c_custkey"),
            "test_accepted_values": lambda: accepted_values(li, "l_returnflag", ["A", "N"]).select("l_orderkey", "l_linenumber"),
            "test_greater_than_or_equal": lambda: greater_than_or_equal(li, "l_quantity", 3).select("l_orderkey", "l_linenumber"),
            "test_greater_than": lambda: greater_than(li, "l_quantity", 3).select("l_orderkey", "l_linenumber"),
            "test_less_than_or_equal": lambda: less_than_or_equal(li, "l_quantity", 48).select("l_orderkey", "l_linenumber"),
            "test_less_than": lambda: less_than(li, "l_quantity", 48).select("l_orderkey", "l_linenumber"),
        }[name]()

    return run


ORACLE = {
    "test_not_null": "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL",
    "test_unique": "SELECT o_custkey AS value, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "test_relationship": "SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderstatus = 'P')",
    "test_accepted_values": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')",
    "test_greater_than_or_equal": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity >= 3",
    "test_greater_than": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity > 3",
    "test_less_than_or_equal": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity <= 48",
    "test_less_than": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity < 48",
}


def queries() -> dict:
    return {name: _of(name) for name in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
