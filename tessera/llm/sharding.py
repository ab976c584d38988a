"""Operator 10. Sharding as vector bin packing.

Rows with equal texts form a group. Groups gather into a bounded number of packets by the hash of their text; a group of
more than a packet's fair share is a packet of its own. Only a group larger than a shard is cut, into as many packets as
shards it fills, by the hash of its rows' ids. Each packet is a vector of bytes, tokens and rows. The driver places these (not the groups: their number is bounded) in falling order of their largest share, each on
the shard where the dot product of the vector with what room is left is highest, among those whose bytes stay in bounds.

The law is ``bytes``: the sums of ``size`` of the shards are near equal; tokens and rows are balanced as far as that lets.
Defined results: a null text counts as empty and has size 1; repeated rows each take a slot; without rows there is no
result; a group stays on one shard unless it has more than a shard's fair share of all bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, spread_rank, table

SHARDS = 16
#: Packets at most of small groups; with large ones twice this number of vectors, and one for each shard.
PACKETS = 4096


def place(vectors: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each vector (rows: bytes, tokens, rows)."""
    total = np.maximum(1.0, vectors.sum(axis=0))
    share = vectors / total * shards  # 1 fills a shard
    room = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((*share.T[::-1], share.max(axis=1)))[::-1]:
        fits = room[:, 0] >= share[i, 0] - 1e-9
        if not fits.any():
            fits = room[:, 0] == room[:, 0].max()
        score = np.where(fits, room @ share[i], -np.inf)
        out[i] = int(score.argmax())
        room[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, packets: int = PACKETS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__h"),
        # words and a closing token
        (F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")) + 1).cast("long").alias("__tokens"),
    )
    rows = cut(rows)  # a few numbers of each row; the texts are read once
    groups = rows.groupBy("__h").agg(F.sum("size").alias("bytes"), F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = groups.agg(F.sum("bytes").alias("n")).collect()[0]["n"] or 0
    fair = max(1, total // packets)
    # a large group holds more than a fair share of all bytes, so there are fewer of these than packets
    full = max(1, -(-total // shards))
    large = {r["__h"]: -(-int(r["bytes"]) // full) for r in groups.where(F.col("bytes") > fair).select("__h", "bytes").collect()}
    pieces = spark_map(docs.sparkSession, large, packets)
    keyed = rows.join(F.broadcast(pieces), "__h", "left").withColumn(
        "__packet",
        F.when(F.col("__first").isNull(), F.pmod("__h", F.lit(packets))).otherwise(F.col("__first") + F.pmod(F.xxhash64("doc_id"), F.col("__parts"))),
    )
    sums = keyed.groupBy("__packet").agg(F.sum("size"), F.sum("__tokens"), F.count(F.lit(1))).orderBy("__packet").toArrow()
    vectors = np.stack([sums.column(i).to_numpy().astype(float) for i in (1, 2, 3)], axis=1) if sums.num_rows else np.zeros((0, 3))
    goes = docs.sparkSession.createDataFrame([(int(p), int(s)) for p, s in zip(sums.column(0).to_pylist(), place(vectors, shards), strict=True)], "__packet long, shard int")
    placed = keyed.join(F.broadcast(goes), "__packet").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    ranked = spread_rank(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot", 64)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def spark_map(spark: SparkSession, large: dict[int, int], first: int) -> DataFrame:
    """(__h, __first packet, __parts) of the large groups."""
    rows = []
    for h, parts in sorted(large.items()):
        rows.append((h, first, parts))
        first += parts
    return spark.createDataFrame(rows, "__h long, __first long, __parts long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
