"""The dialects: how each quotes and comments, which clauses its queries have, and the grammar of its other statements."""

from __future__ import annotations

import re
from functools import cache

from ..functions.grammar import Grammar
from .lexicons import LEXICONS, Lexicon
from .statements import GRAMMARS

NAMES = tuple(sorted(LEXICONS))
#: What the parser of queries gives to the grammars.
TERMINALS = {"name", "object", "string", "number", "query", "expr", "exprs", "value", "type", "any", "word"}


class UnknownDialect(ValueError):
    pass


def lexicon(dialect: str) -> Lexicon:
    if dialect not in LEXICONS:
        raise UnknownDialect(f"unknown dialect: {dialect}; known: {', '.join(NAMES)}")
    return LEXICONS[dialect]


@cache
def grammar(dialect: str) -> Grammar:
    base = lexicon(dialect).base
    return Grammar(GRAMMARS.get(dialect, ""), grammar(base) if base else None)


@cache
def opening_words(dialect: str) -> frozenset[str]:
    """Words that a statement other than a query may begin with."""
    found: set[str] = set()
    g = grammar(dialect)

    def first(body: str, seen: frozenset[str]) -> None:
        for part in re.split(r"\|", body):
            m = re.match(r"[\s(]*(\w+)", part)
            if m and m[1].isupper():
                found.add(m[1].lower())
            elif m and m[1] in g.bodies and m[1] not in seen:
                first(g.bodies[m[1]], seen | {m[1]})

    first(g.bodies["_statement"], frozenset())
    return frozenset(found)


@cache
def keywords(dialect: str) -> frozenset[str]:
    """All words that the dialect's statements and queries have a meaning for, in lower case."""
    from ..functions.lexing import KEYWORDS

    return KEYWORDS | {w.lower() for body in grammar(dialect).bodies.values() for w in re.findall(r"\b[A-Z][A-Z_]+\b", re.sub(r"\"[^\"]*\"", "", body))}
