"""Tools of one text for playgrounds: tokens, tree, formatted form, violations, lineage, scopes and slices, as text."""

from __future__ import annotations

from collections.abc import Callable

from .functions.lexing import lex
from .functions.parsing import Tree
from .functions.templating import render
from .operators import analysis, lint


def tokens(sql: str, dialect: str = "ansi") -> str:
    return "\n".join(f"[{i}] {t.kind} {t.raw!r} {t.start}..{t.start + len(t.raw)}" for i, t in enumerate(lex(sql, dialect)))


def tree(sql: str, dialect: str = "ansi") -> str:
    return "\n".join(f"[L:{r[9]:3}, P:{r[10]:3}] {'    ' * r[6]}{r[3]}:" + ("" if r[7] is None else f" {r[7]!r}") for r in Tree(sql, dialect).rows())


def formatted(sql: str, dialect: str = "ansi") -> str:
    return lint.fix_text(sql, lint.selected("core"), dialect)


def linted(sql: str, dialect: str = "ansi") -> str:
    return "\n".join(f"L:{line:4} | P:{pos:4} | {code} | {why} [{lint.NAMES[code]}]" for code, line, pos, why in lint.lint_text(sql, lint.selected("core"), dialect))


def lineage(sql: str, dialect: str = "ansi") -> str:
    rows, depth, out = analysis.lineage_rows(sql, dialect=dialect), {}, []
    for output, node, parent, name, expression, source, reference in rows:
        depth[node] = 0 if parent is None else depth[parent] + 1
        out.append(f"{'  ' * depth[node]}{name}" + (f" <- {reference}" if reference else f" = {expression}"))
    return "\n".join(out)


def scopes(sql: str, dialect: str = "ansi") -> str:
    return "\n".join(f"{'  ' * bool(ord_)}{kind}" + (f" {alias}" + (f" ({table})" if table and table != alias else "") if ord_ else f" at {at}") for at, kind, alias, table, ord_ in analysis.scope_rows(sql, dialect=dialect))


def templated(sql: str, dialect: str = "ansi") -> str:
    """The text as the Jinja templater gives it without values, and its slices."""
    done = render(sql, "jinja")
    return "\n".join([done.text, *(f"{s.kind} {s.source_start}..{s.source_end} -> {s.start}..{s.end}" for s in done.slices)])


TOOLS: dict[str, Callable[[str, str], str]] = {"lexer": tokens, "parser": tree, "format": formatted, "lint": linted, "lineage": lineage, "scope": scopes, "templater": templated}


def run(tool: str, sql: str, dialect: str = "ansi") -> str:
    if tool not in TOOLS:
        raise ValueError(f"unknown tool: {tool}; known: {', '.join(TOOLS)}")
    return TOOLS[tool](sql, dialect)
