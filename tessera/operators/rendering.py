"""Templaters over files as rows, with the map between source and rendered text as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import lex
from ..functions.templating import Rendered, pattern, render

RENDERED = "path string, source string, rendered string, slices array<struct<kind:string,source_start:int,source_end:int,start:int,end:int>>, error string"


def rendered(files: DataFrame, templater: str = "raw", values: dict | None = None, style: str | None = None, regex: str | None = None) -> DataFrame:
    """(path, source, rendered, slices, error): a file that can't be rendered has its error and null in the two before."""
    if templater == "placeholder":
        pattern(style, regex)
    struct = pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in ("source_start", "source_end", "start", "end"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, slices, errors = [], [], []
            for s in batch.column(1).to_pylist():
                try:
                    got = render(s or "", templater, values, style, regex)
                    texts.append(got.text)
                    slices.append([x._asdict() for x in got.slices])
                    errors.append(None)
                except ValueError as e:
                    texts.append(None)
                    slices.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(slices, pa.list_(struct)), pa.array(errors, pa.string())], ["path", "source", "rendered", "slices", "error"])

    return files.select("path", "source").mapInArrow(run, RENDERED)


def slices(files: DataFrame) -> DataFrame:
    """One row for each slice of ``rendered``."""
    return files.select("path", F.posexplode("slices").alias("ord", "__s")).select("path", "ord", "__s.*")


def literal_only(found: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (path, start, ...) of places in rendered texts, without those in templated slices, with ``source_start``."""
    s = slices(files).where("kind = 'literal'").select(F.col("path").alias("__p"), F.col("start").alias("__a"), F.col("end").alias("__b"), F.col("source_start").alias("__s"))
    met = found.join(s, (F.col("path") == F.col("__p")) & (F.col("start") >= F.col("__a")) & (F.col("start") < F.col("__b")))
    return met.withColumn("source_start", F.col("__s") + F.col("start") - F.col("__a")).drop("__p", "__a", "__b", "__s")


TOKENS = "path string, ord int, kind string, raw string, start int, source_start int, source_end int, slice string"


def mapped(source: str, done: Rendered, dialect: str = "ansi") -> list[tuple]:
    """(ord, kind, raw, start, source start, source end, slice) of each token of the rendered text: where in the source it
    comes from, and whether from a literal, from a template or from both. What renders to nothing stands between the
    tokens as ``placeholder`` rows."""
    rows, slices, at = [], done.slices, 0
    empty = [s for s in slices if s.start == s.end]
    for t in lex(done.text, dialect):
        end = t.start + len(t.raw)
        while empty and empty[0].start <= t.start:
            s = empty.pop(0)
            rows.append((s.kind if s.kind in ("block", "comment") else "placeholder", "", t.start, s.source_start, s.source_end, s.kind))
        while at + 1 < len(slices) and (slices[at].end <= t.start):
            at += 1
        over = [s for s in slices[at:] if s.start < end and t.start < s.end] if slices[at].end < end else [slices[at]]
        first, last = over[0], over[-1]
        a = first.source_start + (t.start - first.start if first.kind == "literal" else 0)
        b = last.source_start + (end - last.start) if last.kind == "literal" else last.source_end
        kinds = {s.kind for s in over}
        rows.append((t.kind, t.raw, t.start, a, b, kinds.pop() if len(kinds) == 1 else "mixed"))
    rows += [(s.kind if s.kind in ("block", "comment") else "placeholder", "", len(done.text), s.source_start, s.source_end, s.kind) for s in empty]
    return [(i, *r) for i, r in enumerate(rows)]


def tokens(files: DataFrame, templater: str = "raw", values: dict | None = None, style: str | None = None, regex: str | None = None, dialect: str = "ansi") -> DataFrame:
    """The tokens of each file's rendered text with the places in the source that they come from; a file that can't be
    rendered has none."""
    fields = [x.split() for x in TOKENS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, *r) for r in mapped(source or "", render(source or "", templater, values, style, regex), dialect)]
                except ValueError:
                    continue
            cols = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    return files.select("path", "source").mapInArrow(run, TOKENS)
