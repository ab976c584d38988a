import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import config
from tessera.functions.templating import STYLES, formatted, placeholder, render
from tessera.operators import rendering
from tessera.sources.sql_files import strings

STYLED = {
    "colon": ("a = :x AND b::int", "a = 1 AND b::int"), "colon_nospaces": ("a=:x", "a=1"), "numeric_colon": ("a = :1", "a = one"), "at": ("a = @x", "a = 1"), "pyformat": ("a = %(x)s", "a = 1"),
    "dollar": ("a = ${x} OR $x", "a = 1 OR 1"), "flyway_var": ("a = ${xy}", "a = 2"), "question_mark": ("a = ? OR ?", "a = one OR 2"), "numeric_dollar": ("a = $1", "a = one"), "percent": ("a = %s", "a = one"),
    "ampersand": ("a = &x", "a = 1"), "apache_camel": ("a = :#${x}", "a = 1"),
}


@pytest.mark.parametrize("style", sorted(STYLES))
def test_styles(style):
    source, want = STYLED[style]
    assert placeholder(source, {"x": 1, "xy": 2, "1": "one"}, style).text == want


def test_errors():
    for bad in ({}, {"style": "colon", "regex": "x"}, {"style": "nope"}):
        with pytest.raises(ValueError):
            render("a", "placeholder", {}, **bad)
    with pytest.raises(ValueError):
        formatted("{a}", {})
    assert formatted("{{{a}}} {b:>3}", {"a": 1, "b": 2}).text == "{1}   2"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a:x 1é\n", max_size=30))
def test_slices_cover_both_texts(source):
    got = placeholder(source, {"x": "long", "a": ""}, "colon")
    at = to = 0
    for s in got.slices:
        assert (s.source_start, s.start) == (at, to)
        at, to = s.source_end, s.end
        if s.kind == "literal":
            assert source[s.source_start : s.source_end] == got.text[s.start : s.end]
    assert (at, to) == (len(source), len(got.text))


def test_templated_places_go(spark):
    files = rendering.rendered(strings(spark, {"a": "x :y z"}), "placeholder", {"y": "long"}, "colon")
    found = spark.createDataFrame([("a", 0), ("a", 3), ("a", 7)], "path string, start int")
    assert {(r["start"], r["source_start"]) for r in rendering.literal_only(found, files).collect()} == {(0, 0), (7, 5)}


def test_config():
    top = config.parse("[tessera]\ndialect = ansi\nrules = core\n[tessera:rules:AL06]\nmin_alias_length = 3\n[other]\nx = 1\n")
    low = config.parse("[tessera]\nrules = LT01,\n  LT02\n[tessera:rules:AL06]\nmax_alias_length = none\n")
    got = config.of_file("/p/q/a.sql", {"/p": top, "/p/q": low, "/z": {"core": {"rules": "no"}}})
    assert got["core"]["rules"] == "LT01,\nLT02" and got["core"]["dialect"] == "ansi" and got["core"]["templater"] == "raw"
    assert config.options(got) == {"AL06.min_alias_length": 3, "AL06.max_alias_length": None}
    assert config.inline("-- tessera:max_line_length:50\nSELECT 1 -- tessera:no:1") == {"core": {"max_line_length": 50}}
