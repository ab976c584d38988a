"""Operator 7. Benchmark decontamination by size-partitioned MinHash containment search, on DataFrame functions alone.

Words are runs of letters and digits of the lower-cased text; a shingle is five words. A document holds an item when it
has at least ``SHARE`` of the item's distinct shingles.

The sketch of an item keeps its shingles of least hash, and how many depends on the item's size class: of n shingles it
keeps the n - ceil(SHARE * n) + 1 least, so that a document holding the item must have one of them. (Banded signatures of
long documents would need thousands of hash functions for the same: an item of 30 shingles has Jaccard 0.005 with a
document of 5,000.) Documents are partitioned by size, and the sketches are searched only in partitions large enough to hold
their items. What the sketch finds is verified by counting the item's distinct shingles in the
document; a shingle is told by a 64-bit hash of its words.

Defined results: null or empty texts hold nothing and are held by nothing; a text of fewer than five words has one
shingle, all its words; rows that repeat an id and text count once; two texts of one item id are searched apart and the
better one is reported; ids may be null; without rows there is no result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, free_name, let, table

WORDS = 5
SHARE = 0.8
#: The sketched shingles and the candidates are each broadcast up to this many; more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, at every word; of a shorter text that of all its words; of none an empty array.

    Runs are built by pairing the list of words with itself: two words, four, then five.
    """
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))

    def runs(w: Column) -> Column:
        def after(x: Column, k: int) -> Column:
            return F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))

        two = let(F.transform(w, lambda x: F.xxhash64(x)), lambda one: F.zip_with(one, after(one, 1), lambda x, y: F.xxhash64(x, y)))
        four = let(two, lambda two_: F.zip_with(two_, after(two_, 2), lambda x, y: F.xxhash64(x, y)))
        five = F.zip_with(four, after(w, 4), lambda x, y: F.xxhash64(x, y))
        short = F.when(F.size(w) == 1, F.filter(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.get(w, F.lit(0)) != "")).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
        return F.when(F.size(w) < WORDS, short).otherwise(F.slice(five, 1, F.size(w) - WORDS + 1))

    return let(F.split(clean, " "), runs)


def _needed(n: Column) -> Column:
    return F.ceil(n * int(100 * SHARE) / F.lit(100))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, __text, shingle, n: of the item, sketched) of each distinct shingle of each item."""
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("__text"), F.explode(F.array_distinct(shingles(F.col("text")))).alias("shingle")).distinct()
    own = W.partitionBy("item_id", "__text")
    n = F.count(F.lit(1)).over(own)
    rank = F.row_number().over(own.orderBy("shingle"))
    return each.select("item_id", "__text", "shingle", n.alias("n"), (rank <= n - _needed(n) + 1).alias("sketched"))


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SHINGLES else df


def candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, __doc: hash of its text, item_id, __text) of each text and item text of ``index`` that share a sketched
    shingle, the document's size partition being large enough."""
    sketches = _broadcast(index.where("sketched").select("item_id", "__text", "shingle", F.floor(F.log2(_needed(F.col("n")) + F.lit(0.5))).alias("__least")))
    # the size partition of a document is the power of two up to its number of shingles
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__doc"), F.inline(F.array(let(shingles(F.col("text")), lambda s: F.struct(F.floor(F.log2(F.size(s) + F.lit(0.5))).alias("__part"), s.alias("__s"))))))
    each = own.select("doc_id", "__doc", "__part", F.explode("__s").alias("shingle"))
    return each.join(sketches, "shingle").where(F.col("__part") >= F.col("__least")).select("doc_id", "__doc", "item_id", "__text").distinct()


def _held(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, __doc: hash of its text, item_id, __text, n, n_shared) of each text and item text that it holds."""
    index = item_shingles(items)
    near = _broadcast(cut(candidates(docs, index)))
    whole = index.groupBy(F.col("item_id").alias("__item"), F.col("__text").alias("__itext"), "n").agg(F.collect_list("shingle").alias("__all"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__h"), "text")
    pairs = texts.join(near, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("__doc")))
    # the document's shingles once for all items that it may hold
    mine = pairs.groupBy("doc_id", "__doc").agg(F.any_value("text").alias("text"), F.collect_set(F.struct("item_id", "__text")).alias("__near"))
    mine = mine.select("doc_id", "__doc", F.array_distinct(shingles(F.col("text"))).alias("__s"), F.explode("__near").alias("__near"))
    met = mine.join(whole, F.col("__near.item_id").eqNullSafe(F.col("__item")) & (F.col("__near.__text") == F.col("__itext")))
    found = met.select("doc_id", "__doc", F.col("__item").alias("item_id"), F.col("__itext").alias("__text"), "n", F.size(F.array_intersect("__s", "__all")).cast("long").alias("n_shared"))
    return found.where(F.col("n_shared") >= _needed(F.col("n")))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of each document and item that it holds."""
    found = _held(docs, items)
    best = F.max_by(F.struct("n_shared", F.col("n").alias("n_item")), F.struct(F.col("n_shared") / F.col("n"), "n"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.n_shared").alias("n_shared"), F.col("b.n_item").alias("n_item"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; ids may repeat or be null."""
    id_, text = free_name(docs, "held_id"), free_name(docs, "held_text")
    held = _held(docs, items).select(F.col("doc_id").alias(id_), F.col("__doc").alias(text)).distinct()
    return docs.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), x AS (
  SELECT DISTINCT kind, id, text, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT kind, id, text, s FROM (
    SELECT kind, id, text, unnest(list_transform(range(greatest(len(w) - {WORDS - 1}, 1)), lambda i: array_to_string(w[i + 1 : i + {WORDS}], ' '))) AS s FROM x) WHERE s <> ''
), n AS (
  SELECT *, count(*) OVER (PARTITION BY id, text) AS n FROM g WHERE kind = 'i'
), h AS (
  SELECT d.id AS doc_id, d.text AS dt, n.id AS item_id, n.text AS it, n.n AS n_item, count(*) AS n_shared
  FROM n JOIN g d ON d.kind = 'd' AND d.s = n.s GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_item FROM h WHERE n_shared >= ceil(n_item * {int(100 * SHARE)} / 100.0)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared / n_item DESC, n_item DESC) = 1
"""
