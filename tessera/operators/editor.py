"""Editor services as tables: tokens with their classes, delta-encoded, and diagnostics counted from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import lint

#: The class of each kind of token; others aren't coloured.
CLASSES = {"keyword": "keyword", "word": "variable", "quoted_identifier": "variable", "quoted_literal": "string", "dollar_literal": "string", "number": "number", "comment": "comment", "block_comment": "comment", "comparison": "operator", "operator": "operator"}


def semantic_tokens(files: DataFrame, dialect: str = "ansi") -> DataFrame:
    """(path, ord, class, delta_line, delta_start, length): places from the token before, in UTF-16 units as editors count.

    A token over several lines is split into its lines.
    """
    tokens = lint.tokens(files, dialect)
    classes = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    each = W.partitionBy("path").orderBy("start")
    # units of a text: its code points, and one more for each beyond the first plane
    units = lambda c: F.length(c) + F.length(F.regexp_replace(c, "[^\\x{10000}-\\x{10FFFF}]", ""))
    before = tokens.select("*", F.coalesce(F.sum(F.when(F.col("raw").contains("\n"), 1).otherwise(0)).over(each.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__block"))
    # what stands before a token in its line: the ends of tokens that reach into it
    placed = before.withColumn("__line", F.col("__block")).withColumn("__tail", F.when(F.col("raw").contains("\n"), units(F.regexp_extract("raw", "[^\\n]*$", 0))))
    lead = F.coalesce(F.last("__tail", True).over(each.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum(F.when(F.col("raw").contains("\n"), 0).otherwise(units(F.col("raw")))).over(W.partitionBy("path", "__line").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.select("path", "start", "line", "raw", "kind", lead.alias("__lead"), "__line").withColumn("__col", own + F.col("__lead"))
    lines = placed.select("path", "start", "line", "kind", "__col", F.posexplode(F.split("raw", "\n")).alias("__k", "__text")).where("__text <> ''")
    rows = lines.select("path", (F.col("line") - 1 + F.col("__k")).alias("line"), F.when(F.col("__k") == 0, F.col("__col")).otherwise(0).alias("col"), classes[F.col("kind")].alias("class"), units(F.col("__text")).alias("length")).where("class IS NOT NULL")
    order = W.partitionBy("path").orderBy("line", "col")
    up, left = F.coalesce(F.lag("line").over(order), F.lit(0)), F.coalesce(F.lag("col").over(order), F.lit(0))
    return rows.select("path", (F.row_number().over(order) - 1).alias("ord"), "class", (F.col("line") - up).alias("delta_line"), F.when(F.col("line") == up, F.col("col") - left).otherwise(F.col("col")).cast("long").alias("delta_start"), F.col("length").cast("long").alias("length"))


def diagnostics(found: DataFrame) -> DataFrame:
    """(path, line, character, severity, code, message) with lines and characters from 0."""
    return found.select("path", (F.col("line") - 1).alias("line"), (F.col("pos") - 1).alias("character"), F.lit("Warning").alias("severity"), "code", F.col("description").alias("message"))
