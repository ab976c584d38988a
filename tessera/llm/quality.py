"""Operator 1. Quality rules: gradient-boosted trees over document statistics.

The trees are grown here from labelled documents, flattened into numpy node arrays and scored for a whole Arrow batch at
once. Chosen features carry monotonic constraints: more repetition or more symbols never raises the score.

Defined results: a null text counts as empty (no words, so ``base_failed``); rows are judged one by one, so repeated rows
repeat the verdict; without usable labels (none, or one class only) the verdict is the base rule alone; other columns of
the input, whatever their names, are ignored by ``verdicts`` and passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded, table

#: Most labelled documents that the trees are grown from; more are cut to this many by the order of a hash of the id.
TRAINING_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "digits", "stops", "line_words", "longest", "capitals")
#: -1: a larger value never raises the score.
MONOTONE = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0], dtype=np.int8)


def measure(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features) of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    put = ids.setdefault
    a = np.array([put(w, len(ids)) for w in words], dtype=np.int64)
    repeated = 0
    if n >= 3:
        v = len(ids)
        pair = a[:-1] * v + a[1:]
        if v > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        _, back, count = np.unique(pair[:-1] * v + a[2:], return_inverse=True, return_counts=True)
        twice = count[back] >= 2
        mask = np.zeros(n, dtype=bool)
        mask[:-2] |= twice
        mask[1:-1] |= twice
        mask[2:] |= twice
        repeated = int(mask.sum())
    per = max(1, n)
    features = [
        float(np.log1p(n)), chars / per, symbols / per, dup / max(1, len(lines)), repeated / per, len(ids) / per,
        sum(map(text.count, "0123456789")) / per, sum(map(text.count, ".!?")) / per, n / max(1, len(lines)),
        float(np.log1p(max(map(len, words), default=0))), sum(x[:1].isupper() for x in lines) / max(1, len(lines)),
    ]
    return n, chars, symbols, dup, repeated, features


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


@dataclass
class Forest:
    """Trees as node arrays: a leaf has feature -1; children of node i are left[i] and right[i]."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20, l2: float = 1.0) -> Forest:
    """Boosts histogram trees on the logistic loss. A constrained split must order its children's values, and passes the
    midpoint down as a bound on both sides, so that the whole forest is monotone in that feature."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(p / (1 - p)))
    margin = np.full(n, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for lst, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            lst.append(v)
        return len(feature) - 1

    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        roots.append(node())
        stack = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while stack:
            at, rows, level, low, high = stack.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            leaf = float(np.clip(sg / (sh + l2), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    b, k = binned[rows, j], len(edges[j]) + 1
                    cg, ch, cn = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
                    lv, rv = np.clip(cg / (ch + l2), low, high), np.clip((sg - cg) / (sh - ch + l2), low, high)
                    ok = (cn >= least) & (len(rows) - cn >= least)
                    if monotone[j]:
                        ok &= (rv - lv) * monotone[j] >= 0
                    gain = np.where(ok, (2 * cg * lv - (ch + l2) * lv**2) + (2 * (sg - cg) * rv - (sh - ch + l2) * rv**2) - (2 * sg * leaf - (sh + l2) * leaf**2), -1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (j, i, lv[i], rv[i]))
            if best[1] is None:
                value[at] = leaf * rate
                margin[rows] += leaf * rate
                continue
            j, i, lv, rv = best[1]
            middle = (lv + rv) / 2
            bounds = {-1: ((middle, high), (low, middle)), 0: ((low, high),) * 2, 1: ((low, middle), (middle, high))}[int(monotone[j])]
            feature[at], threshold[at] = j, float(edges[j][i])
            goes = binned[rows, j] <= i
            left[at], right[at] = node(), node()
            stack += [(left[at], rows[goes], level + 1, *bounds[0]), (right[at], rows[~goes], level + 1, *bounds[1])]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, start)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> Forest | None:
    """Grows the forest from at most ``limit`` labelled documents; None if their labels don't have both classes.

    Several labels of one document count by their mean, at least a half being good.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("__good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    # at most `limit` pairs of numbers, so the broadcast is bounded
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("__good", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = [measure(t)[5] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["good", "x"])

    # documents that share an id may be more than `limit`; keep their number bounded in the same order-free way
    got = some.mapInArrow(features, "good int, x array<double>").orderBy(F.xxhash64("x", "good"), "good").limit(limit).toPandas()
    y, x = got["good"].to_numpy(dtype=float), np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, y))
    if not len(y) or y.min() == y.max():
        return None
    return grow(x[order], y[order])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(texts: list[str | None], forest: Forest | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The five counts, base_failed, kept and score of each text."""
    rows = [measure(t) for t in texts]
    counts = [np.array([r[i] for r in rows], dtype=np.int64) for i in range(5)]
    failed = base_failed(counts[0], counts[4])
    x = np.array([r[5] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    score = forest.probability(x) if forest is not None and len(rows) else np.ones(len(rows))
    return counts, failed, ~failed & (score >= 0.5), score


def verdicts(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """One row for each document row: counts, base rule, verdict, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            counts, failed, kept, score = judge(batch.column(1).to_pylist(), forest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(failed), pa.array(kept), pa.array(score)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist(), forest)[2]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(docs, fit(docs, table(spark, sf_dir, "labels")))
