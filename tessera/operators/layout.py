"""Reflow over files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.parsing import Tree
from ..functions.reflow import Layout, Reflow, depth_map, laid_out
from .analysis import _table

STEPS = ("respace", "rebreak", "reindent", "break_long_lines")


def reflowed(files: DataFrame, step: str | None = None, dialect: str = "ansi", layout: Layout | None = None) -> DataFrame:
    """(path, source) after one step of reflow, or after all; what can't be parsed stays as it is."""
    if step is not None and step not in STEPS:
        raise ValueError(f"unknown step: {step}; known: {', '.join(STEPS)}")

    def of(_: str, source: str) -> list[tuple]:
        if step is None:
            return [(laid_out(source, dialect, layout),)]
        tree = Tree(source, dialect)
        return [(source if list(tree.root.walk("unparsable")) else getattr(Reflow(tree, layout), step)().text,)]

    return _table(files, "path string, source string", of)


def depths(files: DataFrame, dialect: str = "ansi") -> DataFrame:
    """(path, ord, start, depth, kinds): the ancestors of each code token."""

    def of(_: str, source: str) -> list[tuple]:
        tree = Tree(source, dialect)
        return [(i, t.start, len(levels), [x.kind for x in levels]) for i, (t, levels) in enumerate(zip(tree.code, depth_map(tree), strict=True))]

    return _table(files, "path string, ord int, start int, depth int, kinds array<string>", of)
