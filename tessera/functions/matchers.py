"""Lexers built from lists of matchers, for texts that a dialect's own pattern doesn't fit.

Matchers that are functions are asked first, in their order; then all the others as one pattern at the place, of which the
first that fits wins. What nothing fits is one ``unlexable`` stretch, and the lexer goes on after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: Takes a text and a place; gives the place after the match, or None.
Native = Callable[[str, int], "int | None"]
LAST_RESORT = re.compile(r"[^\t\n.]+|.", re.S)


@dataclass(frozen=True)
class Matcher:
    """``pattern`` is a string, a compiled regular expression, or a function. A match is cut at what ``subdivider`` fits, and
    the pieces between lose what ``post_subdivide`` fits at their ends, which become elements of their own."""

    name: str
    pattern: str | re.Pattern | Native
    subdivider: Matcher | None = None
    post_subdivide: Matcher | None = None

    @property
    def native(self) -> bool:
        return callable(self.pattern)

    def regex(self) -> str:
        return re.escape(self.pattern) if isinstance(self.pattern, str) else self.pattern.pattern

    def split(self, raw: str) -> list[tuple[str, str]]:
        """(name, raw) of the pieces of one match."""
        if self.subdivider is None:
            return [(self.name, raw)]
        out, at = [], 0
        for m in re.compile(self.subdivider.regex(), re.S).finditer(raw):
            if m.end() > m.start():
                out += self._trimmed(raw[at : m.start()]) + [(self.subdivider.name, m[0])]
                at = m.end()
        return out + self._trimmed(raw[at:])

    def _trimmed(self, raw: str) -> list[tuple[str, str]]:
        if not raw or self.post_subdivide is None:
            return [(self.name, raw)] if raw else []
        trim = self.post_subdivide.regex()
        lead, tail = re.match(trim, raw), None
        start = lead.end() if lead else 0
        for m in re.finditer(trim, raw[start:]):
            if start + m.end() == len(raw) and m.end() > m.start():
                tail = start + m.start()
        end = len(raw) if tail is None else tail
        parts = [(self.post_subdivide.name, raw[:start]), (self.name, raw[start:end]), (self.post_subdivide.name, raw[end:])]
        return [(n, r) for n, r in parts if r]


class Lexer:
    def __init__(self, matchers: list[Matcher]):
        self.matchers = list(matchers)
        self.first = [m for m in matchers if m.native]
        self.rest = [m for m in matchers if not m.native]
        self.pattern = re.compile("|".join(f"(?P<m{i}>{m.regex()})" for i, m in enumerate(self.rest)) or "(?!)", re.S)

    def patched(self, *matchers: Matcher) -> Lexer:
        """With some matchers replaced by others of their names."""
        new = {m.name: m for m in matchers}
        if unknown := set(new) - {m.name for m in self.matchers}:
            raise ValueError(f"no matcher to patch: {', '.join(sorted(unknown))}")
        return Lexer([new.get(m.name, m) for m in self.matchers])

    def inserted(self, before: str, *matchers: Matcher) -> Lexer:
        i = next((i for i, m in enumerate(self.matchers) if m.name == before), None)
        if i is None:
            raise ValueError(f"no matcher: {before}")
        return Lexer([*self.matchers[:i], *matchers, *self.matchers[i:]])

    def lex(self, text: str) -> list[tuple[str, str, int, int]]:
        """(name, raw, start, end) of the elements; together they are the text."""
        out, at = [], 0
        while at < len(text):
            found, end = None, at
            for m in self.first:
                stop = m.pattern(text, at)
                if stop is not None and stop > at:
                    found, end = m, stop
                    break
            if found is None:
                m = self.pattern.match(text, at)
                if m and m.end() > at:
                    found, end = self.rest[int(m.lastgroup[1:])] if re.fullmatch(r"m\d+", m.lastgroup or "") else next(r for i, r in enumerate(self.rest) if m[f"m{i}"] is not None), m.end()
            if found is None:
                end = LAST_RESORT.match(text, at).end()
                out.append(("unlexable", text[at:end], at, end))
            else:
                place = at
                for name, raw in found.split(text[at:end]):
                    out.append((name, raw, place, place + len(raw)))
                    place += len(raw)
            at = end
        return out


def nested_comment(opening: str = "/*", closing: str = "*/") -> Native:
    """A function matcher for comments that nest; one that doesn't end runs to the end of the text."""
    both = re.compile(f"{re.escape(opening)}|{re.escape(closing)}")

    def match(text: str, at: int) -> int | None:
        if not text.startswith(opening, at):
            return None
        depth = 0
        for m in both.finditer(text, at):
            depth += 1 if m[0] == opening else -1
            if depth == 0:
                return m.end()
        return len(text)

    return match
