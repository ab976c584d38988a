"""Rendering of templated SQL: raw, placeholder, format and Jinja templates, with slices that map the source to the rendered text."""

from __future__ import annotations

import re
import string
from typing import NamedTuple

from . import jinja

#: The places that each style gives parameters; a group ``param_name`` names one, others are numbered from 1.
STYLES = {
    "colon": r"(?<![:\w\\]):(?P<param_name>\w+)(?!:)",
    "colon_nospaces": r"(?<!:):(?P<param_name>\w+)",
    "numeric_colon": r"(?<![:\w\\]):(?P<param_name>\d+)",
    "at": r"(?<![:\w\\])@(?P<param_name>\w+)",
    "pyformat": r"(?<![:\w\\])%\((?P<param_name>[\w_]+)\)s",
    "dollar": r"(?<![:\w\\])\${?(?P<param_name>[\w_]+)}?",
    "flyway_var": r"\${(?P<param_name>\w+[:\w_]+)}",
    "question_mark": r"(?<![:\w\\])\?",
    "numeric_dollar": r"(?<![:\w\\])\${?(?P<param_name>[\d]+)}?",
    "percent": r"(?<![:\w\\])%s",
    "ampersand": r"(?<!&)&{?(?P<param_name>[\w]+)}?",
    "apache_camel": r":#\$\{(?P<param_name>.+)}",
}


class Slice(NamedTuple):
    kind: str  # literal, templated, or block and comment, which come out as nothing
    source_start: int
    source_end: int
    start: int
    end: int


class Rendered(NamedTuple):
    text: str
    slices: list[Slice]

    def source_of(self, at: int) -> int:
        """The place in the source of a place in the rendered text: its own in a literal, else the slice's first."""
        for s in self.slices:
            if s.start <= at < s.end:
                return s.source_start + (at - s.start if s.kind == "literal" else 0)
        return self.slices[-1].source_end if self.slices else 0


def _join(parts: list[tuple[str, int, int, str]]) -> Rendered:
    out, slices, at = [], [], 0
    for kind, a, b, text in parts:
        if a < b or text:
            slices.append(Slice(kind, a, b, at, at + len(text)))
            out.append(text)
            at += len(text)
    return Rendered("".join(out), slices)


def raw(source: str) -> Rendered:
    return _join([("literal", 0, len(source), source)])


def pattern(style: str | None = None, regex: str | None = None) -> re.Pattern:
    if (style is None) == (regex is None):
        raise ValueError("give either param_style or param_regex")
    if style is not None and style not in STYLES:
        raise ValueError(f"unknown param_style: {style}")
    return re.compile(regex if style is None else STYLES[style])


def placeholder(source: str, values: dict, style: str | None = None, regex: str | None = None) -> Rendered:
    """Each parameter is replaced by its value, or by its own name if there is none."""
    parts, at, unnamed = [], 0, 0
    for m in pattern(style, regex).finditer(source):
        name = m.groupdict().get("param_name")
        if name is None:
            unnamed += 1
            name = str(unnamed)
        value = values.get(name, name)
        if not isinstance(value, (str, int, bool)):
            raise ValueError(f"invalid value for the parameter {name}")
        text = str(value).lower() if isinstance(value, bool) else str(value)
        parts += [("literal", at, m.start(), source[at : m.start()]), ("templated", m.start(), m.end(), text)]
        at = m.end()
    return _join([*parts, ("literal", at, len(source), source[at:])])


def formatted(source: str, values: dict) -> Rendered:
    """``str.format`` fields filled from ``values``; doubled braces stand for one."""
    parts, at, formatter = [], 0, string.Formatter()
    for m in re.finditer(r"\{\{|\}\}|\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", source):
        if m[0] in ("{{", "}}"):
            text = m[0][0]
        else:
            try:
                text = formatter.vformat(m[0], (), values)
            except (KeyError, IndexError, AttributeError) as e:
                raise ValueError(f"no value for {m[0]}") from e
        parts += [("literal", at, m.start(), source[at : m.start()]), ("templated", m.start(), m.end(), text)]
        at = m.end()
    return _join([*parts, ("literal", at, len(source), source[at:])])


def render(source: str, templater: str = "raw", values: dict | None = None, style: str | None = None, regex: str | None = None) -> Rendered:
    if templater == "raw":
        return raw(source)
    if templater == "placeholder":
        return placeholder(source, values or {}, style, regex)
    if templater == "python":
        return formatted(source, values or {})
    if templater in ("jinja", "dbt"):
        pieces, _ = jinja.render(source, jinja.model_values(values or {}) if templater == "dbt" else values or {})
        return _join(pieces)
    raise ValueError(f"unknown templater: {templater}")
