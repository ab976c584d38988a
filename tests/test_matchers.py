"""Lexers from matchers, and tokens tied to the slices of templates."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.matchers import Lexer, Matcher, nested_comment
from tessera.functions.templating import render
from tessera.operators.rendering import mapped

NEWLINE = Matcher("newline", "\n")
SPACE = Matcher("whitespace", re.compile(r"[^\S\n]+"))
BASE = Lexer([SPACE, NEWLINE, Matcher("comment", nested_comment(), None), Matcher("line", re.compile(r"--[^\n]*")), Matcher("text", re.compile(r"'(?P<q>[^']*)'"), NEWLINE, SPACE), Matcher("arrow", "->"), Matcher("word", re.compile(r"\w+")), Matcher("sign", re.compile(r"[-+*.,]"))])


def test_kinds_of_matchers():
    assert [(n, r) for n, r, _, _ in BASE.lex("a->b - 'x' /* a /* b */ */ -- z\n")] == [("word", "a"), ("arrow", "->"), ("word", "b"), ("whitespace", " "), ("sign", "-"), ("whitespace", " "), ("text", "'x'"), ("whitespace", " "), ("comment", "/* a /* b */ */"), ("whitespace", " "), ("line", "-- z"), ("newline", "\n")]
    assert [(n, r) for n, r, _, _ in BASE.lex("' a\n b '")] == [("text", "' a"), ("newline", "\n"), ("whitespace", " "), ("text", "b '")]
    assert BASE.lex("a ?? b")[2][:2] == ("unlexable", "?? b") and BASE.lex("/* open")[0][:2] == ("comment", "/* open")


def test_changes_of_lexers():
    more = BASE.inserted("word", Matcher("number", re.compile(r"\d+"))).patched(Matcher("arrow", "=>"))
    assert [x[0] for x in more.lex("1=>a")] == ["number", "arrow", "word"] and [x[0] for x in BASE.lex("1")] == ["word"]
    for bad in (lambda: BASE.patched(Matcher("zzz", "z")), lambda: BASE.inserted("zzz", NEWLINE)):
        with pytest.raises(ValueError):
            bad()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab '\n-/*>?é.", max_size=40))
def test_loses_nothing(text):
    out = BASE.lex(text)
    assert "".join(r for _, r, _, _ in out) == text and all(text[a:b] == r for _, r, a, b in out)


def test_tokens_know_their_slices():
    source = "SELECT {{ a }}x, {# c #}{% if y %}b{% endif %} FROM {{ t }}"
    rows = mapped(source, render(source, "jinja", {"a": "pre_", "t": "u AS v", "y": 1}))
    at = {r[2]: r for r in rows if r[2]}
    assert at["pre_x"][6] == "mixed" and source[at["pre_x"][4] : at["pre_x"][5]] == "{{ a }}x"
    assert at["b"][6] == "literal" and source[at["b"][4] : at["b"][5]] == "b" and at["u"][6] == at["v"][6] == "templated"
    assert [r[1] for r in rows if not r[2]] == ["comment", "block", "block"]
    assert source[at["FROM"][4] : at["FROM"][5]] == "FROM"
