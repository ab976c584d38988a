"""Operator 9. Near-duplicates by bottom-k sketches from one hash function.

Texts with the same shingle set fall into one class at once. The sketch of a class keeps the ``SKETCH`` least shingle
hashes. Two sets of at least the wanted similarity share far more than that similarity less ``SLACK`` of their sketch
values, so that each class needs to stand only in the inverted lists of its rarest values, as many as exceed that share. Short lists give
their pairs. A long list gives no pairs: its members ("crowded" classes) are indexed again by their full sets, where the
rarest values up to the exact bound suffice, and in a list that is still long each member is paired with the member that
has fewest shingles of its own; only members that don't turn out linked to it are then paired with others, as far as
sizes and places in the lists' common order allow. Candidates are estimated on the sketch of their union, then verified on
full sets. Components come from alternating large-star and small-star steps on the verified links.

Defined results: a null text, an empty one and one without words have an empty set, are linked with nothing and stay;
texts with fewer words than a shingle have one shingle, all their words; rows that repeat a doc_id are one node of the
graph for each text; null ids are never the smallest of a group unless all are null; one row of each group is kept, of the
smallest id and then text hash, also where ids repeat or are null; other columns don't matter. Sets are told by a 64-bit hash
with their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded, cut, free_name, table

SKETCH = 64
#: A pair as similar as wanted shares this much less of its sketch values at least, but for one pair in a million.
SLACK = 0.29
#: Longer inverted lists don't give all their pairs.
LONG = 32
#: Shingles of the sets that a worker remembers while it verifies pairs.
HELD = 1_500_000
#: Shingles that a worker returns at once: texts that repeat themselves are far longer than what they are compressed to.
LISTED = 250_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, words: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], dtype=np.uint64)
    seen: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for x in w:
        if x not in seen:
            seen[x] = digest(x)
    h = np.array([seen[x] for x in w], dtype=np.uint64)
    out = np.zeros(len(w) - words + 1, np.uint64)
    for i in range(words):
        out = (out ^ h[i : len(w) - words + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - 2**63


def _long(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def _members(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h: of the text, c: class, n, values: the sketch) of each row; the sketch stands once or so for a class in a
    partition, and is null in its other rows."""
    schema = "doc_id long, h long, c long, n int, values array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in bounded(batches):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            classes = [class_of(s) if len(s) else None for s in sets]
            if len(told) > 1_000_000:
                told.clear()
            sketches = [_long(s[:SKETCH]) if c is not None and c not in told and not told.add(c) else None for c, s in zip(classes, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "h", "c", "n", "values"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, schema)


def _rarest(lists: DataFrame, size: Column, share: float) -> DataFrame:
    """(value, c, n, own: values that no other class has, at: place in the order) of the rarest values of each class.

    ``lists`` has (c, n, value); a class needs the lists of all but floor(share * size) of its values. Values of one
    class only can't lead to a pair, so they are counted and left out.
    """
    # written first: the join then shuffles both sides itself, and the rows of a common value can be split over tasks
    often = cut(lists.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    shared = lists.join(often, "value").dropDuplicates(["c", "value"])
    each = W.partitionBy("c")
    own = size - F.count(F.lit(1)).over(each)
    at = own + F.row_number().over(each.orderBy("often", "value"))
    ranked = shared.select("value", "c", "n", own.cast("int").alias("own"), at.cast("int").alias("at"), size.alias("size"))
    return ranked.where(F.col("at") <= F.col("size") - F.ceil(share * F.col("size")) + 1).drop("size")


def _pairs(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """(a, b) with a < b of the members of a list, as far as their sizes and places let them be similar."""
    x = left.select("value", F.col("c").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    y = right.select("value", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    # in the list of the first value that two sets share, neither shares what comes before it in the common order
    common = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    met = x.join(y, "value").where((F.col("a") != F.col("b")) & (common >= share * (F.col("na") + F.col("nb") - common) - 1e-6))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left, right = (texts.select(F.col("c").alias(k), F.col("z").alias(f"z{k}")) for k in "ab")
    percent = round(100 * share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        sets: dict[int, np.ndarray] = {}
        held = 0

        def of(c: int, z: bytes) -> np.ndarray:
            nonlocal held
            if c not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                sets[c] = shingle_set(unzip.decompress(z).decode("utf-8", "surrogatepass"), words)
                held += len(sets[c])
            return sets[c]

        for batch in bounded(batches):
            columns = [batch.column(i).to_pylist() for i in range(4)]
            ok = [similar(of(a, za), of(b, zb), percent) for a, b, za, zb in zip(*columns, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; a hopeless estimate on the union's sketch spares the full sets."""
    lowest = np.union1d(x[:SKETCH], y[:SKETCH])[:SKETCH]
    both = np.isin(lowest, x[:SKETCH], assume_unique=True) & np.isin(lowest, y[:SKETCH], assume_unique=True)
    if both.sum() < (percent / 100 - SLACK) * len(lowest):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def components(links: DataFrame) -> DataFrame:
    """(c, root: the least class of its component) of every class in ``links`` (a, b)."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = both(e)
        if not large:
            around = around.where("b < a")
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        to = around.where("b > a") if large else around
        moved = to.join(least, "a").select(F.col("b").alias("x"), "m")
        if not large:
            moved = moved.unionByName(least.select(F.col("a").alias("x"), "m"))
        return moved.where("x != m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()

    edges, before = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        edges = cut(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            return edges.select(F.col("a").alias("c"), F.col("b").alias("root"))
        before = now


def _lists(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    values = pa.array([_long(s) for _, _, s in held], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in held], pa.int64()), pa.array([n for _, n, _ in held], pa.int32()), values], ["c", "n", "values"])


def groups(docs: DataFrame, words: int = 3, share: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``; one row of each group is kept."""
    return _grouped(docs, words, share).drop("h")


def _grouped(docs: DataFrame, words: int, share: float) -> DataFrame:
    """(doc_id, h: of the text, n_shingles, component_id, kept) of each row of ``docs``."""
    # once computed, a row's number tells it from equal rows
    sketched = cut(_members(docs, words).withColumn("row", F.monotonically_increasing_id()))
    members = sketched.drop("values")
    floor = share - SLACK
    sketches = sketched.where(F.col("values").isNotNull()).select("c", "n", F.explode("values").alias("value"))
    listed = cut(_rarest(sketches, F.least("n", F.lit(SKETCH)), floor))
    # lists are counted, written and only then joined, so that a long list's rows can be split over tasks
    lengths = cut(listed.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1"))
    # places in a sketch say nothing certain of the full set
    short = listed.withColumn("at", F.lit(1)).join(lengths.where(F.col("length").between(2, LONG)), "value")
    near = cut(_pairs(short, short.where("true"), share))
    crowd = cut(listed.join(lengths.where(F.col("length") > LONG), "value").select("c").distinct())
    wanted = near.select(F.col("a").alias("c")).unionByName(near.select(F.col("b").alias("c"))).unionByName(crowd).distinct()
    texts = cut(_texts(docs, members, wanted, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in bounded(batches):
            held: list[tuple[int, int, np.ndarray]] = []
            size = 0
            for c, n, z in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((c, n, shingle_set(unzip.decompress(z).decode("utf-8", "surrogatepass"), words)))
                size += len(held[-1][2])
                if size > LISTED:
                    yield _lists(held)
                    held, size = [], 0
            yield _lists(held)

    full = texts.join(crowd, "c", "left_semi").select("c", "n", "z").mapInArrow(run, "c long, n int, values array<long>").select("c", "n", F.explode("values").alias("value"))
    deep = cut(_rarest(full, F.col("n"), share))
    lengths = cut(deep.groupBy("value").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct("own", "c")).alias("hub")).where("length > 1").select("value", "length", F.col("hub.c").alias("hub")))
    deep = cut(deep.join(lengths, "value"))
    brief = deep.where(F.col("length") <= LONG)
    to_hub = deep.where((F.col("length") > LONG) & (F.col("c") != F.col("hub"))).select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()
    links = cut(_verified(near.unionByName(_pairs(brief, brief.where("true"), share)).unionByName(to_hub).distinct(), texts, words, share))
    # members of long lists that aren't linked to the hub meet all others of the list
    linked = links.select(F.struct("a", "b").alias("__l"))
    crowded = deep.where(F.col("length") > LONG)
    alone = crowded.where(F.col("c") != F.col("hub")).withColumn("__l", F.struct(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b"))).join(linked, "__l", "left_anti").select(*crowded.columns)
    more = _verified(_pairs(alone, crowded.where(F.col("c") != F.col("hub")), share), texts, words, share)
    roots = components(links.unionByName(more))
    classes = members.where(F.col("c").isNotNull()).groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "row")).alias("least"))
    rooted = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("least")))
    # written for the same reason: a class may have a third of all rows
    named = cut(rooted.select("c", "root").join(least, "root").select("c", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first")))
    out = members.join(named, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("c").isNull() | (F.col("row") == F.col("first"))
    return out.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _texts(docs: DataFrame, members: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(c, n, z: a text, compressed) of each class wanted, one row for each."""
    nowhere = -(2**63)
    # summed up before anything is joined: a class of many copies sends one row from each task
    rep = members.where(F.col("c").isNotNull()).groupBy("c").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(nowhere)).alias("id"), "h")).alias("one"))
    rep = rep.join(wanted, "c", "left_semi").select(F.col("one.id").alias("__id"), F.col("one.h").alias("__h")).distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nowhere)).alias("__id"), F.xxhash64("text").alias("__h"), "text").join(rep, ["__id", "__h"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in bounded(batches):
            texts = batch.column(0).to_pylist()
            sets = [shingle_set(t, words) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(sets[i]) for i in some], pa.int64()), pa.array([len(sets[i]) for i in some], pa.int32()), pa.array([squeeze.compress(texts[i].encode("utf-8", "surrogatepass")) for i in some], pa.binary())], ["c", "n", "z"])

    # equal rows of one id and text give their class once each
    return rows.select("text").mapInArrow(run, "c long, n int, z binary").dropDuplicates(["c"])


def one_of_each(docs: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group does; of equal rows that with the least other columns."""
    # the ids and texts of which a row goes; of those where one is kept, one stays
    gone = _grouped(docs, words, share).groupBy("doc_id", "h").agg(F.min("kept").alias("all"), F.max("kept").alias("one")).where(~F.col("all"))
    id_, h, one, row = (free_name(docs, x) for x in ("gone_id", "gone_text", "gone_one", "gone_row"))
    gone = cut(gone.select(F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("one").alias(one)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(h))
    whole = docs.join(gone, same, "left_anti")
    equal = docs.join(gone.where(one), same).groupBy(id_, h).agg(F.min(F.struct(*docs.columns)).alias(row))
    return whole.unionByName(equal.select(f"{row}.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
