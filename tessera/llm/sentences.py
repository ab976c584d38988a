"""Operator 8. Sentence spans that repeat: every run of consecutive sentences that reaches ``WORDS`` words is hashed, one
run for each sentence it begins at, the hashes are joined over all documents, and a sentence is removed when a run covers
it that is not the first of its kind.

A sentence is a run of characters up to and with ``.``, ``!``, ``?`` or a line break (several in a row end one sentence),
or ``WORDS`` words without these; together the sentences are the whole text, and what is kept is the text with whole
sentences cut out. A run has as few sentences as reach ``WORDS`` words, so its length is bounded by words and not by a
number of sentences: many short sentences and a single long one are told alike. Runs are compared by their words with
single spaces between, through 96 bits of hash. The first of a kind is that of the smallest (doc_id, sentence number).

Defined results: a null text counts as empty; what follows the last sentence with ``WORDS`` words from it on begins no run,
so shorter texts lose nothing; a null doc_id comes first in the order; repeated rows with one doc_id and text tie: the
runs of one id and place are one occurrence, so neither of such rows loses to the other; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table

#: A run is as long as it takes to reach so many words.
WORDS = 30
_SPACE = "\\x20\\x09\\x0B-\\x0D"
#: One sentence; the second way cuts long stretches without an end, the third is what is left at the end of the text.
_LETTERS = f"[^.!?\\n{_SPACE}]"
SENTENCE_PATTERN = f"[{_SPACE}]*(?:{_LETTERS}+[{_SPACE}]+){{0,{WORDS}}}{_LETTERS}*[.!?\\n]+|[{_SPACE}]*(?:{_LETTERS}+[{_SPACE}]+){{{WORDS}}}|[^.!?\\n]+"
SENTENCE = re.compile(SENTENCE_PATTERN)
FIRST_ID = -(2**63)
SPANS = "__id long, __h long, span long, more int, at int, upto int"
KEPT = "doc_id long, n_sentences long, n_removed long, text string"


def runs_of(text: str) -> list[tuple[int, int, int, int]]:
    """(64 bits of hash, 32 more, first sentence, sentence after the last) of each run of the text."""
    words = [(i, w) for i, s in enumerate(SENTENCE.findall(text)) if (w := s.encode("utf-8", "surrogatepass").split())]
    clean = [b" ".join(w) for _, w in words]
    total = np.concatenate([[0], np.cumsum([len(w) for _, w in words], dtype=np.int64)])
    ends = np.searchsorted(total, total[:-1] + WORDS)  # the first place where the sum is reached
    out = []
    for k, e in enumerate(ends.tolist()):
        if e > len(words):
            break
        h = xxhash.xxh3_128_intdigest(b" ".join(clean[k:e]))
        out.append(((h >> 64) - 2**63, (h & 0xFFFFFFFF) - 2**31, words[k][0], words[e - 1][0] + 1))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    for batch in bounded(batches):
        got = [runs_of(t) for t in batch.column(2).to_pylist()]
        times = [len(g) for g in got]
        keys = [pa.array(np.repeat(batch.column(i).to_numpy(), times)) for i in (0, 1)]
        cols = list(zip(*(x for g in got for x in g), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in SPANS.split(", ")])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        rows = []
        for doc, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            all_ = SENTENCE.findall(text)
            gone = {p for x in places or () for p in range(x["at"], x["upto"])}
            rows.append((doc, len(all_), len(gone), "".join(s for i, s in enumerate(all_) if i not in gone) if gone else text))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(),) * 3 + (pa.string(),), strict=True)], ["doc_id", "n_sentences", "n_removed", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of each row of ``docs``; ``text`` is what is kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the hash also tells a null id from the least one, whose number it borrows
    rows = rows.withColumns({"__id": F.coalesce("doc_id", F.lit(FIRST_ID)), "__h": F.xxhash64("text", F.col("doc_id").isNull())})
    spans = rows.select("__id", "__h", "text").mapInArrow(_find, SPANS)
    # one decimal number orders by (doc_id, place); unlike a struct it can be summed up in a hash table
    place = (F.col("__id").cast("decimal(38,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("at")).cast("decimal(38,0)")
    # written, so that the join has a shuffle of its own on both sides and a common run's rows can be split over tasks
    kinds = cut(spans.groupBy("span", "more").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("span", "more", "first"))
    lost = spans.join(kinds, ["span", "more"]).where(place != F.col("first")).groupBy("__id", "__h").agg(F.collect_set(F.struct("at", "upto")).alias("__at"))
    return rows.join(lost, ["__id", "__h"], "left").select("doc_id", "text", "__at").mapInArrow(_cut_out, KEPT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH s AS (
  SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE_PATTERN}') AS x FROM documents)
), c AS (
  SELECT *, trim(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g')) AS c FROM s
), w AS (
  SELECT doc_id, pos, c, len(string_split(c, ' ')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM c WHERE c <> ''
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM w
), a AS (
  SELECT doc_id, list(c ORDER BY k) AS cs FROM w GROUP BY doc_id
), r AS (
  SELECT b.doc_id, b.pos, e.pos AS last, b.k, e.k AS lk
  FROM (SELECT *, upto - n + {WORDS} AS target FROM u) b ASOF JOIN u e ON b.doc_id = e.doc_id AND b.target <= e.upto
), k AS (
  SELECT r.doc_id, r.pos, r.last, row_number() OVER (PARTITION BY array_to_string(a.cs[r.k : r.lk], ' ') ORDER BY r.doc_id, r.pos) AS nth
  FROM r JOIN a USING (doc_id)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM k WHERE nth > 1
)
SELECT d.doc_id, count(s.pos) AS n_sentences, count(g.pos) AS n_removed,
       coalesce(string_agg(s.s, '' ORDER BY s.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = s.doc_id AND g.pos = s.pos
GROUP BY d.doc_id
"""
