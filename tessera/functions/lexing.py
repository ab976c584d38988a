"""A lossless lexer for SQL text: each character lies in exactly one token."""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

#: The words told apart from identifiers.
KEYWORDS = frozenset("""
all and any as asc between by case cast create cross delete desc distinct drop else end except exists false fetch first for from full
grant group having if in inner insert intersect into is join last lateral left like limit minus natural not null nulls offset on or
order outer over partition qualify range recursive right row rows select set table then top true union unique unnest update using
values view when where window with
""".split())


class Token(NamedTuple):
    kind: str
    raw: str
    start: int
    line: int
    pos: int


@cache
def pattern(dialect: str) -> re.Pattern:
    from ..dialects import lexicon

    x = lexicon(dialect)
    escaped, plain = "(?:[^{q}\\\\]|\\\\.|{q}{q})*", "(?:[^{q}]|{q}{q})*"
    quoted = lambda q, inner: q + inner.replace("{q}", q) + q
    literals = [f"[{x.escaping}]" + quoted("'", escaped), "[uU]&" + quoted("'", plain)] if x.escaping else []
    if x.triple:
        literals += [f"(?:[{x.prefixes}]{{1,2}})?{q * 3}.*?{q * 3}" for q in x.literal]
    literals += [f"(?:[{x.prefixes}]{{1,2}}(?={q}))?" + quoted(q, escaped if x.backslash else plain) for q in x.literal]
    identifiers = [quoted(q, plain) for q in x.identifier] + ([r"\[[^\]\[]+\]"] if x.square else [])
    comment = "--[^\n]*" + "".join(f"|{re.escape(c)}[^\n]*" for c in x.comments)
    # a colon after a name or a bracket is a path or a slice, no parameter
    parameter = "|".join(f"(?<![\\w\\]:)\"])(?:{p})" if p.startswith(":") else p for p in x.parameter.split("|")) if x.parameter else "(?!)"
    return re.compile(
        rf"(?P<newline>\n)|(?P<whitespace>[^\S\n]+)|(?P<comment>{comment})|(?P<templated>\{{\{{.*?\}}\}}|\{{%.*?%\}}|\{{#.*?#\}})"
        rf"|(?P<dollar_literal>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<quoted_literal>{'|'.join(literals)})|(?P<quoted_identifier>{'|'.join(identifiers)})"
        rf"|(?P<cast>::)|(?P<parameter>{parameter})"
        + r"|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>[^\W\d][\w$%s]*|\d+\w+)|(?P<comparison><=>|<>|!=|>=|<=|=|<|>)" % x.letters
        + r"|(?P<operator>\|\||[-+*/%&|^~!?@:$#])|(?P<comma>,)|(?P<dot>\.)|(?P<semicolon>;)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<unlexable>.)",
        re.S,
    )


def block_comment(text: str, at: int) -> int:
    """End of the comment that begins at ``at``; comments nest."""
    depth, i = 0, at
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        i = m.end()
        if not depth:
            return i
    return len(text)


def lex(text: str, dialect: str = "ansi") -> list[Token]:
    out, at, line, begin = [], 0, 1, 0
    match = pattern(dialect).match
    while at < len(text):
        if text[at] == "/" and text.startswith("/*", at):
            kind, end = "block_comment", block_comment(text, at)
        else:
            m = match(text, at)
            kind, end = m.lastgroup if m.lastgroup != "tag" else "dollar_literal", m.end()
        raw = text[at:end]
        if kind == "word" and raw.lower() in KEYWORDS and not (out and out[-1].kind == "dot"):
            kind = "keyword"
        out.append(Token(kind, raw, at, line, at - begin + 1))
        if "\n" in raw:
            line += raw.count("\n")
            begin = at + raw.rindex("\n") + 1
        at = end
    return out
