"""Operator 4. Language ID of mixed-language text.

The script of a word's first letter narrows its candidate languages, character n-grams score the word for each of them,
and Viterbi over the words, with a penalty for each switch, labels spans of one language.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0; a word in a script that no
training text uses is neutral; ties go to the language that sorts first; without training rows every text is ``und``.
Rows are labelled one by one, whatever other columns the table has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table

#: The classifier is fitted on about this many documents of each language at most, drawn by a hash of the id.
TRAINING_DOCS = 3000
BITS = 16
SWITCH = 24.0
#: Starts of script ranges and the script that begins there (0: none of those told apart).
SCRIPTS = ((0x0000, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0E00, 10), (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x1400, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 14), (0x3100, 0), (0x3400, 15), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 0))
STARTS, KINDS = np.array([a for a, _ in SCRIPTS]), np.array([k for _, k in SCRIPTS])
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in each Python process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the 3- and 4-grams by position, positions counted, word of each position, first letter of each word,
    letters of each word) of a lower-cased text; what is no letter acts as a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[np.minimum(c, 0x10FFFF)]
    c = np.where(is_letter, c, 32).astype(np.uint32)
    c = np.concatenate([np.full(3, 32, np.uint32), c, np.full(1, 32, np.uint32)])
    inside = np.concatenate([np.zeros(3, bool), is_letter, np.zeros(1, bool)])
    begins = inside[1:] & ~inside[:-1]
    word = np.cumsum(begins)
    at = np.flatnonzero(inside[3:] | inside[2:-1]) + 3  # each letter and the place after a word
    x = c[at] * np.uint32(0x9E3779B1) + c[at - 1] * np.uint32(0x85EBCA6B) + c[at - 2] * np.uint32(0xC2B2AE35)
    y = x + c[at - 3] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    hashes = np.stack([_mixed(x), _mixed(y)])
    first = np.flatnonzero(begins) + 1
    counts = np.bincount(word[inside[1:]] - 1, minlength=len(first)) if len(first) else np.zeros(0, int)
    return hashes, at, word[at - 1] - 1, c[first], counts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (x ^ (x >> np.uint32(13))) >> np.uint32(32 - BITS)


def script(points: np.ndarray) -> np.ndarray:
    return KINDS[np.searchsorted(STARTS, points, side="right") - 1]


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # hash x language
    allowed: np.ndarray  # script x language

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word for each language, the best being 0 and a barred one very low; letters of each word."""
        hashes, _, word, first, counts = grams(text)
        if not len(first):
            return np.zeros((0, len(self.langs)), np.float32), counts
        each = self.logs[hashes[0]] + self.logs[hashes[1]]
        score = np.add.reduceat(each, np.searchsorted(word, np.arange(len(first))), axis=0)
        ok = self.allowed[script(first)]
        score = np.where(ok, score, np.float32(-1e4))
        score[~ok.any(axis=1)] = 0
        return score - score.max(axis=1, keepdims=True), counts


def viterbi(score: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word, where each change of language costs ``penalty``.

    Where no stretch of words gains as much as one switch costs, the path is the best single language; only the other
    texts are walked word by word.
    """
    n, k = score.shape
    if not n:
        return np.zeros(0, int)
    best = int(score.sum(axis=0, dtype=np.float64).argmax())
    if k == 1:
        return np.zeros(n, int)
    rest = np.delete(score, best, axis=1).max(axis=1) - score[:, best]
    total = np.concatenate([[0.0], np.cumsum(rest, dtype=np.float64)])
    if (total - np.minimum.accumulate(total)).max() <= penalty:
        return np.full(n, best)
    came = np.empty((n, k), np.int16)
    own = list(range(k))
    now = [float(v) for v in score[0]]
    for t, row in enumerate(score.tolist()):
        if not t:
            continue
        top = max(now)
        where, top = now.index(top), top - penalty
        back = [i if now[i] >= top else where for i in own]
        came[t] = back
        now = [(now[i] if now[i] >= top else top) + row[i] for i in own]
    path = np.empty(n, int)
    path[-1] = now.index(max(now))
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """The language with most letters in its spans, and its share of the letters."""
    score, counts = model.words(text or "")
    if not len(counts) or not model.langs:
        return "und", 0.0
    share = np.bincount(viterbi(score), weights=counts, minlength=len(model.langs))
    return model.langs[int(share.argmax())], float(share.max() / share.sum())


def spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """(first word, word after the last, language) of each span of the text."""
    score, _ = model.words(text or "")
    path = viterbi(score)
    if not len(path):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [(a, b, model.langs[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def fit(docs: DataFrame, most: int = TRAINING_DOCS) -> Model:
    """Learns from (text, lang, __h: a hash to draw by) rows; about ``most`` documents of a language are drawn."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != "und"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((KINDS.max() + 1, 0), bool))
    index = {x: i for i, x in enumerate(langs)}
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, most / sizes[x])])
    drawn = rows.where(F.pmod("__h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("lang", "text")
    top = int(KINDS.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in bounded(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table_ = seen.setdefault(index[lang], np.zeros((1 << BITS) + top, np.int64))
                hashes, _, _, first, counts = grams(text)
                table_[: 1 << BITS] += np.bincount(hashes.ravel(), minlength=1 << BITS)
                table_[1 << BITS :] += np.bincount(script(first), weights=counts, minlength=top).astype(np.int64)
        for i, table_ in seen.items():
            at = np.flatnonzero(table_)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(table_[at])], ["lang", "cell", "n"])

    # summed in Spark; what comes back is bounded by languages x cells, whatever the corpus
    sums = drawn.mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    full = np.zeros(((1 << BITS) + top, len(langs)))
    full[sums["cell"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
    n, by_script = full[: 1 << BITS], full[1 << BITS :]
    logs = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * (1 << BITS)))
    return Model(langs, logs.astype(np.float32), by_script >= 0.005 * np.maximum(1, by_script.sum(axis=0)))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def label(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            got = [predict(model, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", out.alias("held_out"))
    model = fit(docs.where(~F.col("held_out")).select("text", "lang", F.xxhash64("doc_id").alias("__h")))
    return label(docs, model)
