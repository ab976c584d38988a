"""Projects: configuration by folder, templates, suppression, ignore files, formats, exit codes, the command line."""

import io
import json

import pytest

from tessera import __main__ as command
from tessera.functions import config, jinja
from tessera.functions.templating import render
from tessera.operators import lint, project
from tessera.sources import sql_files
from tessera.sources.ignore import Ignore

JINJA = [
    ("{{ a }}", "1"), ("{{ b | upper }}-{{ b|replace('x','y') }}", "XX-yy"), ("{% if a == 1 %}yes{% else %}no{% endif %}", "yes"), ("{% if a == 2 %}x{% elif c is defined %}y{% else %}z{% endif %}", "z"),
    ("{% for i in l %}{{ i }}{% if not loop.last %}, {% endif %}{% endfor %}", "1, 2, 3"), ("{% for i in [] %}x{% else %}none{% endfor %}", "none"), ("{% set q = a + 2 %}{{ q * 2 }}", "6"), ("{% set q %}t{{ a }}{% endset %}{{ q }}", "t1"),
    ("{% macro m(x, y='d') %}{{ x }}{{ y }}{% endmacro %}{{ m('a') }}{{ m('b', y='c') }}", "adbc"), ("a  {%- if true -%}  b  {%- endif -%}  c", "abc"), ("x{# note #}y", "xy"), ("{% raw %}{{ a }}{% endraw %}", "{{ a }}"),
    ("{{ d.k.n }} {{ d['k']['n'] }} {{ l[0] }}{{ l[1:] | join('/') }}", "5 5 12/3"), ("{{ c }}|{{ c | default('none') }}", "|none"), ("{{ 'a' ~ a ~ 'b' }}", "a1b"), ("{{ l | length }} {{ 'q' in b }} {{ a is odd }} {{ a is not none }}", "3 false true true"),
    ("{% for k, v in d.items() %}{{ k }}{{ v.n }}{% endfor %}", "k5"), ("{{ 'x' if a > 1 else 'y' }}", "y"),
]


@pytest.mark.parametrize(("source", "want"), JINJA)
def test_jinja(source, want):
    got = render(source, "jinja", {"a": 1, "b": "xx", "l": [1, 2, 3], "d": {"k": {"n": 5}}})
    assert got.text == want
    for s in got.slices:
        assert s.kind != "literal" or source[s.source_start : s.source_end] == got.text[s.start : s.end]
    assert "".join(got.text[s.start : s.end] for s in got.slices) == want


@pytest.mark.parametrize("bad", ["{% if a %}x", "{{ a b }}", "{{ a | nope }}", "{% frob %}", "{{ c.d }}", "{{ c() }}", "{{ (1).__class__ }}x{{ [].__class__() }}", "{% for x in l %}{% for y in m %}{% for z in m %}{{ x }}{% endfor %}{% endfor %}{% endfor %}"])
def test_jinja_errors(bad):
    with pytest.raises(ValueError):
        render(bad, "jinja", {"a": 1, "l": list(range(10**4)), "m": list(range(100))})


def test_undefined_names_and_models():
    _, missing = jinja.render("{{ a }}{{ b }}", {"a": 1})
    assert missing == {"b"}
    got = render("{{ config(materialized='table') }}SELECT {{ var('x', 3) }} FROM {{ ref('m') }} JOIN {{ source('s', 't') }}{% if is_incremental() %} WHERE 1{% endif %}", "dbt", {"vars": {}})
    assert got.text == "SELECT 3 FROM m JOIN s.t"


def lint_it(source, conf="", rules="CV04,LT12"):
    s = project.settings(config.merge(config.DEFAULTS, config.parse(conf), {"core": {"rules": rules}}))
    return [x[:4] for x in project.lint_source(source, s)]


def test_configuration_reaches_the_rules():
    long = "SELECT " + "a" * 50 + "\n"
    assert lint_it(long, "[tessera]\nmax_line_length = 40", "layout.long_lines") == [("LT05", "layout.long_lines", 1, 1)]
    assert not lint_it(long, "", "LT05")
    assert lint_it("SELECT count(1)\n", "", "convention.count_rows") == [("CV04", "convention.count_rows", 1, 8)]
    for bad in ("[tessera]\ndialect = klingon", "[tessera]\nrules = ZZ99"):
        with pytest.raises(ValueError):
            project.settings(config.merge(config.DEFAULTS, config.parse(bad)))
    assert lint.selected("aliasing.table,CP", "CP01") == ["AL01", "CP02", "CP03", "CP04", "CP05"] and set(lint.NAMES) == set(lint.RULES)


def test_templated_places_are_left_alone():
    jinja_on = "[tessera]\ntemplater = jinja\n[tessera:templater:jinja:context]\nf = count(1)"
    # the violation stands in what the template gives, then in the text itself
    assert lint_it("SELECT {{ f }}, a\n", jinja_on) == []
    assert lint_it("SELECT {{ f }},\n    count(1) AS {{ f }}\n", jinja_on.replace("count(1)", "x")) == [("CV04", "convention.count_rows", 2, 5)]
    assert lint_it("SELECT {{f}}\n", jinja_on, "JJ01") == [("JJ01", "jinja.padding", 1, 8)]
    assert lint_it("SELECT {{ nope() }}\n", jinja_on)[0][0] == "TMP"
    style = "[tessera]\ntemplater = placeholder\n[tessera:templater:placeholder]\nparam_style = colon\nx = count(1)"
    assert lint_it("SELECT :x, count(0)\n", style) == [("CV04", "convention.count_rows", 1, 12)]


def fix_it(source, conf="", rules="CV04,LT12,CP01"):
    s = project.settings(config.merge(config.DEFAULTS, config.parse(conf), {"core": {"rules": rules}}))
    return project.fix_source(source, s)


def test_fixes_stay_out_of_templates():
    jinja_on = "[tessera]\ntemplater = jinja\n[tessera:templater:jinja:context]\nf = count(1)"
    assert fix_it("SELECT count(1), {{ f }} from t", jinja_on) == "SELECT count(*), {{ f }} FROM t\n"
    assert fix_it("{% for i in [1, 2] %}SELECT count(1) from t;{% endfor %}\n", jinja_on) == "{% for i in [1, 2] %}SELECT count(1) from t;{% endfor %}\n"  # it comes out twice
    assert fix_it("{% if true %}SELECT count(0) from t{% endif %}\n", jinja_on) == "{% if true %}SELECT count(*) FROM t{% endif %}\n"
    assert fix_it("SELECT count({{ 1 }}) FROM t\n", jinja_on) == "SELECT count({{ 1 }}) FROM t\n" and fix_it("SELECT {{ nope() }} from t", jinja_on) == "SELECT {{ nope() }} from t"
    assert fix_it("SELECT count(1) from t") == "SELECT count(*) FROM t\n" and fix_it("SELEC count(1) FRM") == "SELEC count(1) FRM"


def test_fixed_projects(spark):
    files = {"file:///p/a/x.sql": "SELECT count(1)", "file:///p/b/y.sql": "SELECT count(1)", "file:///p/b/z.sql": "-- tessera:dialect:klingon\nSELECT count(1)"}
    got = {r["path"][8:]: (r["source"], r["changed"]) for r in project.fixed(sql_files.strings(spark, files), CONFIGS).collect()}
    assert got == {"p/a/x.sql": ("SELECT count(1)\n", 1), "p/b/y.sql": ("SELECT count(*)\n", 1), "p/b/z.sql": (files["file:///p/b/z.sql"], 0)}


def test_suppression():
    assert lint_it("SELECT count(1) -- noqa: convention.count_rows\n") == [] == lint_it("SELECT count(1) /* x -- noqa */\n")
    assert lint_it("SELECT count(1) -- because -- noqa: CV04, LT01\n") == []
    assert lint_it("SELECT count(1) -- noqa: LT01\n") == [("CV04", "convention.count_rows", 1, 8)]
    assert lint_it("SELECT a -- noqa\n", "[tessera]\nwarn_unused_ignores = true") == [("NOQA", "noqa", 1, 10)]
    assert lint_it("SELEC a FRM t\n")[0][:3] == ("PRS", "parsing", 1)


FILES = {"file:///p/a/x.sql": "SELECT count(1)\n", "file:///p/b/y.sql": "SELECT count(1)\n", "file:///p/b/z.sql": "-- tessera:rules:LT12\nSELECT count(1)", "file:///p/ok.sql": "SELECT 1\n", "file:///p/odd.sql": "-- tessera:dialect:klingon\nSELECT 1\n", "file:///p/none.sql": None}
CONFIGS = {"file:///p": {"core": {"rules": "CV04,LT12"}}, "file:///p/a": {"core": {"exclude_rules": "CV04"}}}


@pytest.mark.parametrize("mode", project.MODES)
def test_projects(spark, mode):
    found = project.violations(sql_files.strings(spark, FILES), CONFIGS, mode=mode)
    assert sorted((r["path"][8:], r["code"], r["line"], r["pos"]) for r in found.collect()) == [("p/b/y.sql", "CV04", 1, 8), ("p/b/z.sql", "LT12", 2, 15), ("p/odd.sql", "CFG", 1, 1)]
    with pytest.raises(ValueError):
        project.violations(sql_files.strings(spark, FILES), {"file:///p": {"core": {"rules": "XX01"}}})
    with pytest.raises(ValueError):
        project.violations(found, mode="fast")


def test_formats_and_codes(spark):
    files = sql_files.strings(spark, {"a.sql": "SELECT count(1),\n  count(0)\n", "b.sql": "SELECT 1\n"})
    found = project.violations(files, overrides={"core": {"rules": "CV04"}})
    text = {k: [r["text"] for r in project.formatted(found, k).collect()] for k in project.FORMATTERS}
    assert text["none"] == [] and len(text["github-annotation-native"]) == 2
    assert text["human"][0].split("\n")[:2] == ["== [a.sql] FAIL", 'L:   1 | P:   8 | CV04 | Use count(*) to express "count number of rows". [convention.count_rows]']
    first = json.loads(text["json"][0])[0]
    assert first["range"] == {"start": {"line": 0, "character": 7}, "end": {"line": 0, "character": 12}} and first["severity"] == "Warning" and first["code"] == "CV04"
    assert project.exit_code(found) == 1 and project.exit_code(found.limit(0)) == 0 and project.fix_exit_code(found) == 0
    assert "1 of them" in project.completion(2, 1)
    with pytest.raises(ValueError):
        project.formatted(found, "smoke")


def test_ignore_files():
    skip = Ignore("# note\n*.tmp.sql\n/only_top.sql\nbuild/\n!keep.tmp.sql\ndocs/**/old.sql\na?[0-9].sql\nx/**\n\\#odd.sql\n**/deep.sql\n")
    yes = ["a.tmp.sql", "d/a.tmp.sql", "only_top.sql", "build/a.sql", "d/build/b/c.sql", "docs/old.sql", "docs/a/b/old.sql", "ab1.sql", "x/y.sql", "#odd.sql", "q/deep.sql", "build/keep.tmp.sql"]
    no = ["keep.tmp.sql", "d/only_top.sql", "build.sql", "old.sql", "abc.sql", "x.sql", "d/keep.tmp.sql"]
    assert [p for p in yes if not skip(p)] == [] and [p for p in no if skip(p)] == []


def test_reading_skips_and_writing_back(spark, tmp_path):
    for name, text in (("a.SQL", "SELECT count(1)\r\n"), ("sub/b.sql", "SELECT 1"), ("gone/c.sql", "x"), ("d.txt", "no"), ("e.sql.j2", "SELECT 2\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    files = sql_files.read(spark, str(tmp_path), ignore_file="gone/\n")
    assert sorted(r["path"].rpartition("/")[2] for r in files.collect()) == ["a.SQL", "b.sql", "e.sql.j2"]
    assert sql_files.read(spark, str(tmp_path), ignore=(".*",)).count() == 0
    assert sql_files.write_back(spark, lint.fixed(files, "CV04,LT12")) == 2
    assert (tmp_path / "a.SQL").read_text() == "SELECT count(*)\n" and (tmp_path / "sub/b.sql").read_text() == "SELECT 1\n"
    got = sql_files.standard_input(spark, io.StringIO("SELECT 1\r\n")).collect()
    assert [tuple(r) for r in got] == [("-", "SELECT 1\n")]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / ".tessera").write_text("[tessera]\nrules = CV04\n")
    (tmp_path / "a.sql").write_text("SELECT count(1)\n")
    monkeypatch.setattr(type(spark), "stop", lambda _: None)
    assert command.main(["lint", str(tmp_path), "--format", "github-annotation-native"], spark) == 1
    assert "CV04" in capsys.readouterr().out
    assert command.main(["fix", str(tmp_path)], spark) == 0 and (tmp_path / "a.sql").read_text() == "SELECT count(*)\n"
    assert command.main(["lint", str(tmp_path)], spark) == 0
    assert "All finished" in capsys.readouterr().err
    assert command.main(["parse", str(tmp_path)], spark) == 0 and "select_clause" in capsys.readouterr().out
