"""Operator 3. Packing by shortest-pack-first over the length histogram.

Each document becomes byte-level BPE ids and a closing id 0; ids beyond a multiple of the sequence length go into full
pieces, the rest into one shorter piece. Only the histogram of piece lengths (at most 1,024 numbers) comes to the driver:
lengths are placed longest first, each time on the packs with least in them among those with room, and a pattern keeps
the number of its packs. Each piece then finds its pack by its rank among the pieces of its length.

Defined results: a null or empty text is the closing id alone; the string of an added token (``<|endoftext|>``) is its one
id, as the tokenizers library has it; every row is a document of its own, also when rows repeat;
without rows there are no pieces; other columns don't matter.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, spread_rank, table

LENGTH = 1024
#: A worker's memory of chunks that it has encoded is emptied at this size.
MEMORY = 400_000
_encoders: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """Ids of the byte-level BPE vocabulary as little-endian unsigned 32-bit bytes.

    The vocabulary's splitting rule never joins characters across a single space between two other characters, so a text
    of such spaces is encoded chunk by chunk, and a chunk seen before is looked up. Other texts are encoded whole. The
    ids are those of the tokenizers library as it comes (the tests compare them), so the string of an added token in a text
    is that token's id; with ``plain`` it is ordinary text. The ranks file is read as it encodes faster.
    """

    def __init__(self, vocabulary: str, plain: bool = False):
        import public_tokenizers as public
        import tiktoken

        with open(public.path(vocabulary), encoding="utf-8") as f:
            added = [] if plain else json.load(f)["added_tokens"]
        self.added = {x["content"]: np.array([x["id"]], dtype="<u4").tobytes() for x in added}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

        with open(public.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def bytes(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return b"".join(self.added.get(x) or self.ordinary(x) for x in self.cuts.split(text) if x)
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        chunks = text.split(" ")
        if "" in chunks or any(x[0].isspace() or x[-1].isspace() for x in chunks):
            return self.whole(text)
        seen = self.later
        if len(seen) > MEMORY:
            seen.clear()
        out = [self.whole(chunks[0])]
        for x in chunks[1:]:
            got = seen.get(x)
            if got is None:
                got = self.whole(" " + x)
                if len(x) <= 64:
                    seen[x] = got
            out.append(got)
        return b"".join(out)


def encoder(vocabulary: str, plain: bool) -> Encoder:
    if (vocabulary, plain) not in _encoders:
        _encoders[vocabulary, plain] = Encoder(vocabulary, plain)
    return _encoders[vocabulary, plain]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH, plain: bool = False) -> DataFrame:
    """The pieces of each document row: ``length`` ids each, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, plain)
        for batch in bounded(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.bytes(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                rows += [(doc, at, min(length, n - at), zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)]), n) for at in range(0, n, length)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in PIECES.split(", ")])
        enc.later.clear()  # the worker may go on to other stages

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs): lengths go longest first onto the emptiest packs that have room.

    Open packs are kept by how much is in them; each step takes the pattern with least in it and splits off as many of
    its packs as there are pieces left, so the number of patterns grows by one for a length at most.
    """
    empty: list[tuple[int, int, tuple[int, ...], int]] = []  # (in it, order, lengths, packs)
    order = 0
    done: list[tuple[tuple[int, ...], int]] = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        if size == length:
            done.append(((size,), left))
            continue
        again = []
        while left:
            if not empty or empty[0][0] + size > length:
                again.append((size, (size,), left))
                break
            filled, _, lengths, packs = heapq.heappop(empty)
            take = min(packs, left)
            left -= take
            again.append((filled + size, (*lengths, size), take))
            if packs > take:
                order += 1
                heapq.heappush(empty, (filled, order, lengths, packs - take))
        for filled, lengths, packs in again:
            if filled == length:
                done.append((lengths, packs))
            else:
                order += 1
                heapq.heappush(empty, (filled, order, lengths, packs))
    return done + [(lengths, packs) for _, _, lengths, packs in sorted(empty)]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which its next run of pieces begins, the run's first sequence, its offset in the pack."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, packs in patterns:
        at = 0
        for size in lengths:
            runs.setdefault(size, []).append((used.get(size, 0), base, at))
            used[size] = used.get(size, 0) + packs
            at += size
        base += packs
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


PACKED = f"{PIECES}, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH, plain: bool = False) -> DataFrame:
    """One row for each piece with its sequence and its offset there. Sequences not filled are padded to ``length``."""
    parts = cut(pieces(docs, vocabulary, length, plain))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan(counts, length))
    ranked = spread_rank(parts, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k in np.unique(size):
                rows = np.flatnonzero(size == k)
                begins, first, at = where[int(k)]
                i = np.searchsorted(begins, rank[rows], side="right") - 1
                seq[rows], off[rows] = first[i] + rank[rows] - begins[i], at[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], [x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(run, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
