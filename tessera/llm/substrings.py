"""Operator 6. Exact substring dedup: bytes covered by a 400-byte string that begins anywhere else go.

Every 400-byte window is told by the least hash of its 32-byte strings, its anchor, and neighbouring windows of one anchor
form a run; equal windows have equal anchors. Runs whose anchor stands at one place in the corpus can't repeat. Runs equal in all
their bytes fall together by a hash, and all of them go. The different runs of one anchor, one of each kind, meet in one
shard, where the suffixes of their bytes are sorted by external induction (``induced``) and neighbours with a common
prefix of 400 bytes or more tell what repeats. An anchor with many different runs is split: its runs are cut where the
distance to the anchor is a multiple of ``PART``, and each piece is dealt by the bytes that all its windows share.

Defined results: a null text counts as empty; texts under 400 bytes lose nothing; repeated rows are copies of each other,
so both lose all that a window covers; ids may be null or shared; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced
from .common import BATCH_BYTES, bounded, cut, table

WIDTH = 400
GRAM = 32
#: Longer runs are cut; only texts that repeat themselves have them.
RUN = 1024
#: An anchor with more different runs than this is split.
CROWD = 48
PART = 32


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at each place."""
    n = len(b) - 7
    words = np.empty(n, np.uint64)
    for o in range(8):
        k = (len(b) - o) // 8
        words[o::8] = np.frombuffer(b, np.uint64, k, o)
    out = np.zeros(len(b) - GRAM + 1, np.uint64)
    for i, m in zip(range(0, GRAM, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), strict=True):
        x = words[i : i + len(out)] * np.uint64(m)
        out = (out ^ x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(28))


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each place's 32 bytes, anchor of each window)."""
    h = gram_hashes(b)
    over, m, size = WIDTH - GRAM + 1, h, 1
    while 2 * size <= over:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(h) - over + 1
    return h, np.minimum(m[:n], m[over - size : over - size + n])


def runs(b: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(anchor, first window, window after the last, loop) of each run of a text's bytes; in a loop the anchor stands more
    than once, so that windows of the run may equal each other."""
    if len(b) < WIDTH:
        return []
    h, m = anchors(b)
    lo = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    hi = np.concatenate([lo[1:], [len(m)]])
    cuts = [(x, min(x + RUN, y)) for a, y in zip(lo.tolist(), hi.tolist(), strict=True) for x in range(a, y, RUN)]
    return [(int(m[x]), x, y, bool(np.count_nonzero(h[x : y + WIDTH - GRAM] == m[x]) > 1)) for x, y in cuts]


def parts(b: np.ndarray, anchor: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(key, first window, window after the last) of the pieces of a run: windows that hold the anchor at distances of
    one multiple of ``PART``, keyed by the bytes that they all share."""
    at = np.flatnonzero(gram_hashes(b[lo : hi + WIDTH - 1]) == np.uint64(anchor)) + lo
    windows = np.arange(lo, hi)
    place = at[np.searchsorted(at, windows)]
    block = (place - windows) // PART
    begins = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (block[1:] != block[:-1])) + 1, [len(windows)]])
    out = []
    for i, k in zip(begins[:-1], begins[1:], strict=True):
        p, q = int(place[i]), int(block[i])
        core = b[p - PART * q : p - PART * q - PART + 1 + WIDTH].tobytes()
        out.append((xxhash.xxh3_64_intdigest(core, seed=q) - 2**63, int(windows[i]), int(windows[k - 1]) + 1))
    return out


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


RUNS = "id long, h long, anchor long, kind long, lo int, hi int, loop boolean"


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        rows = []
        for id_, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            b = _bytes(text)
            view = memoryview(b)
            rows += [(id_, h, a - 2**63, xxhash.xxh3_64_intdigest(view[lo : hi + WIDTH - 1]) - 2**63, lo, hi, loop) for a, lo, hi, loop in runs(b)]
        yield _columns(rows, RUNS)


PIECES = "shard long, id long, h long, lo int, asked int, alone boolean, loop boolean, kind long, bytes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that were chosen in each text, split where their anchor is crowded."""
    unzip = zstandard.ZstdDecompressor()
    for batch in bounded(batches):
        rows = []
        for id_, h, z, want in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            b = np.frombuffer(unzip.decompress(z), np.uint8)
            for w in want:
                cuts = parts(b, w["anchor"] + 2**63, w["lo"], w["hi"]) if w["crowd"] else [(w["anchor"], w["lo"], w["hi"])]
                for key, lo, hi in cuts:
                    own = b[lo : hi + WIDTH - 1].tobytes()
                    rows.append((key, id_, h, lo, hi - lo, w["alone"], w["loop"], xxhash.xxh3_64_intdigest(own) - 2**63, own))
                if len(rows) > 2000:
                    yield _columns(rows, PIECES)
                    rows = []
        yield _columns(rows, PIECES)


COVERED = "id long, h long, lo int, hi int"


def _stretches(hit: np.ndarray, lo: int) -> list[tuple[int, int]]:
    """Bytes (first, after the last) that the windows marked in ``hit`` cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(lo + int(a), lo + int(b) + WIDTH - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What repeats within the shards of a task; small shards are sorted together."""

    def done(rows: list[dict], find=induced.repeated) -> pa.RecordBatch:
        hits = find([r["bytes"] for r in rows], [r["asked"] for r in rows], WIDTH)
        return _columns([(r["id"], r["h"], a, b) for r, hit in zip(rows, hits, strict=True) if r["alone"] for a, b in _stretches(hit, r["lo"])], COVERED)

    held: list[dict] = []  # whole shards
    shard: list[dict] = []  # the one that is being read
    held_bytes = size = 0

    def ended() -> Iterator[pa.RecordBatch]:
        nonlocal held, held_bytes, shard, size
        if size > LARGE_SHARD:
            yield done(shard, induced.repeated_by_hash)
        else:
            if held_bytes + size > SHARD_BYTES and held:
                yield done(held)
                held, held_bytes = [], 0
            held += shard
            held_bytes += size
        shard, size = [], 0

    for batch in batches:
        for r in batch.to_pylist():
            if shard and r["shard"] != shard[-1]["shard"]:
                yield from ended()
            shard.append(r)
            size += len(r["bytes"])
    if shard:
        yield from ended()
    if held:
        yield done(held)


#: Whole shards are sorted together until they hold so many bytes.
SHARD_BYTES = 1_500_000
#: A single shard of more bytes than this isn't sorted in memory; its windows are told by their hashes and compared.
LARGE_SHARD = 4_000_000
RESULT = "doc_id long, n_removed long, n_spans long, kept_sha256 string, n_bytes long, n_kept long, text string"


def merged(stretches: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: they travel twice, to their chosen runs and to what was found."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in bounded(batches):
        z = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], [x.split()[0] for x in PACKED.split(", ")])


PACKED = "doc_id long, id long, h long, z binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in bounded(batches):
        rows, held = [], 0
        for id_, z, gone in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            b = unzip.decompress(z)
            spans = merged([(g["lo"], g["hi"]) for g in gone or ()])
            at, parts = 0, []
            for x, y in spans:
                parts.append(b[at:x])
                at = y
            kept = b"".join((*parts, b[at:]))
            rows.append((id_, len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(b), len(kept), kept.decode("utf-8", "replace")))
            held += len(kept)
            if held > BATCH_BYTES:  # texts that repeat themselves are far longer than what they are compressed to
                yield _columns(rows, RESULT)
                rows, held = [], 0
        yield _columns(rows, RESULT)


def covered(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, h, lo, hi): bytes covered by repeated windows, for rows (id, h, text); ``packed`` has the texts compressed."""
    found = cut(rows.mapInArrow(_runs, RUNS))  # hashing every text is the dear part, so it is done once
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("loop").alias("loop")).where("n > 1 or loop").select("anchor")
    found = cut(found.join(twice, "anchor"))
    kinds = cut(found.groupBy("anchor", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("loop").alias("loop"), F.min(F.struct("id", "h", "lo", "hi")).alias("one")))
    whole = found.join(kinds.where("n > 1").select("anchor", "kind"), ["anchor", "kind"]).select("id", "h", "lo", (F.col("hi") + WIDTH - 1).cast("int").alias("hi"))
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.col("loop") & (F.col("n") == 1)).alias("loops")).where("kinds > 1 or loops").select("anchor", "kinds")
    chosen = kinds.join(mixed, "anchor").select(F.col("one.id").alias("id"), F.col("one.h").alias("h"), F.struct("anchor", "one.lo", "one.hi", (F.col("kinds") > CROWD).alias("crowd"), (F.col("n") == 1).alias("alone"), "loop").alias("want"))
    chosen = chosen.groupBy("id", "h").agg(F.collect_list("want").alias("want"))
    pieces = packed.join(chosen, ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "h", "z", "want").mapInArrow(_pieces, PIECES)
    pieces = cut(pieces)
    # equal pieces of a split run fall together as runs did
    same = pieces.groupBy("shard", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("loop").alias("loop"), F.min(F.struct("id", "h", "lo")).alias("one"))
    many = same.where("n > 1").select("shard", "kind")
    again = pieces.where("alone").join(many, ["shard", "kind"]).select("id", "h", "lo", (F.col("lo") + F.col("asked") + WIDTH - 1).cast("int").alias("hi"))
    varied = same.groupBy("shard").agg(F.count(F.lit(1)).alias("kinds"), F.max("loop").alias("loop")).where("kinds > 1 or loop").select("shard")
    firsts = same.join(varied, "shard").select("shard", "kind", "n", F.col("one.id").alias("id"), F.col("one.h").alias("h"), F.col("one.lo").alias("lo"))
    shards = pieces.join(firsts, ["shard", "kind", "id", "h", "lo"]).withColumn("alone", F.col("alone") & (F.col("n") == 1)).select("shard", "id", "h", "lo", "asked", "alone", "bytes")
    rest = shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sorted, COVERED)
    return whole.unionByName(again).unionByName(rest)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept_sha256, n_bytes, n_kept, text: what is left) of each row of ``docs``.

    Removal counts bytes, so a stretch may end inside a character; ``text`` shows such a broken end as U+FFFD.
    """
    nowhere = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(nowhere)).alias("id"), F.xxhash64("text").alias("h"), "text")
    packed = rows.mapInArrow(_packed, PACKED)
    gone = covered(rows.select("id", "h", "text"), packed).groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    return packed.join(gone, ["id", "h"], "left").select("doc_id", "z", "gone").mapInArrow(_cut_out, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
