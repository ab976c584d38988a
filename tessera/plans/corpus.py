"""A corpus of SQL files written by SQL from ``part``, one for each row, and the queries of the analysis operators over it.

The same SQL writes the texts in Spark and in DuckDB; the oracles then find violations, tokens, trees and lineage in them
by string functions alone, without lexer, parser or rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, editor, layout, lint, rendering
from . import dialect_corpus, rule_corpus

#: One model for each part; what is in it follows from the key.
MODELS = """
SELECT concat('models/m', p_partkey, '.sql') AS path, concat(
  CASE WHEN p_partkey % 11 = 0 THEN chr(10) ELSE '' END,
  'SELECT a.c', p_size, ', ', CASE p_partkey % 4 WHEN 0 THEN 'COUNT(1)' WHEN 1 THEN 'COUNT(*)' WHEN 2 THEN 'MAX(a.v)' ELSE 'COUNT(0)' END, ' AS n', chr(10),
  'FROM t', p_size, ' AS a', chr(10),
  CASE WHEN p_partkey % 3 = 0 THEN concat('INNER JOIN u', p_size, ' AS b ON a.id = b.id', chr(10)) ELSE '' END,
  'WHERE a.x = ', CASE WHEN p_partkey % 6 = 0 THEN 'NULL' ELSE concat('''', p_type, '''') END,
  CASE WHEN p_partkey % 13 = 0 THEN concat(' AND a.y IN (', repeat('1, ', 30), '1)') ELSE '' END,
  CASE WHEN p_partkey % 9 = 0 THEN ' -- noqa' ELSE '' END, chr(10),
  'GROUP BY a.c', p_size,
  CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN concat(chr(10), chr(10)) ELSE chr(10) END) AS source
FROM part
"""
BROKEN = f"SELECT path, CASE WHEN path LIKE '%7.sql' THEN replace(source, 'SELECT', 'SELEC') ELSE source END AS source FROM ({MODELS})"
TEMPLATES = "SELECT concat('q/', p_partkey, '.sql') AS path, concat('SELECT :col FROM t', p_size, ' WHERE a = :v', CASE WHEN p_partkey % 2 = 0 THEN ' AND b::int = 1 OR c = :none' ELSE '' END) AS source FROM part"
#: Nothing is qualified here.
BARE = """SELECT concat('b', p_partkey) AS path, concat('WITH q AS (SELECT * FROM t', p_size, ')', ' SELECT ', CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE 'v, max(w)' END, ' FROM q JOIN (SELECT w FROM u', p_size, ') ON v = w') AS source FROM part"""
#: Assertions on the sources and on some of the models.
ASSERTIONS = f"""
SELECT 'not_null' AS kind, concat('t', p_size) AS path, concat('c', p_size) AS column, NULL AS value FROM part GROUP BY p_size
UNION ALL SELECT 'greater_than', concat('t', p_size), 'v', '0' FROM part GROUP BY p_size
UNION ALL SELECT 'unique', path, 'n', NULL FROM ({MODELS})
UNION ALL SELECT 'not_null', path, regexp_extract(source, 'c[0-9]+', 0), NULL FROM ({MODELS})
"""
#: A laid out text and the same with its spaces, line breaks and indents in disorder.
TIDY = "concat('SELECT', chr(10), '    a', p_partkey, ',', chr(10), '    sum(b) AS s', chr(10), 'FROM t', p_size, ' AS t', chr(10), 'INNER JOIN u', chr(10), '    ON t.k = u.k', chr(10), '        AND t.x > -1', chr(10), 'WHERE t.y IN (1, 2)', chr(10))"
MESS = f"SELECT concat('l/', p_partkey) AS path, replace(replace(replace(replace(replace({TIDY}, ', 2', ' ,2'), ' AS s', '   AS s  '), '    ON', '  ON'), concat(chr(10), '        AND t.x > -1'), concat(' AND', chr(10), 't.x > - 1')), concat(',', chr(10), '    sum('), concat(chr(10), CASE WHEN p_partkey % 2 = 0 THEN ' , ' ELSE ',' END, 'sum  (')) AS source FROM part"
#: Templates that say of themselves what they give.
JINJA = """SELECT concat('j/', p_partkey) AS path, concat('SELECT {% if ', p_partkey, ' is even %}a{% else %}b{% endif %}, {{ ', p_size, ' * 2 + 1 }}{% set q = [', p_size, ', 7] %}{% for i in q %}, c{{ i }}{% if loop.last %} AS z{% endif %}{% endfor %}{# gone #} FROM {{ name | upper }}{%- if missing is defined %} WHERE 1{% endif %}') AS source FROM part"""
FORMATTED = "SELECT concat('f/', p_partkey) AS path, concat('SELECT a', p_size, ', {{x}} FROM {t} WHERE n = {n:03d}') AS source FROM part"
STYLED = {"colon": ":x", "colon_nospaces": ":x", "numeric_colon": ":1", "at": "@x", "pyformat": "%(x)s", "dollar": "${x}", "flyway_var": "${xy}", "question_mark": "?", "numeric_dollar": "$1", "percent": "%s", "ampersand": "&x", "apache_camel": ":#${x}"}
RULES = "CV04,CV05,LT05,LT12,LT13"


def files(spark: SparkSession, sf_dir: str, text: str = MODELS) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(text)


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, ASSERTIONS).selectExpr("kind", "path", "column", "CAST(value AS STRING) AS value", "CAST(NULL AS ARRAY<STRING>) AS values", "CAST(NULL AS STRING) AS target_path", "CAST(NULL AS STRING) AS target_column")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.violations(files(spark, sf_dir), RULES)


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.rendered(files(spark, sf_dir, TEMPLATES), "placeholder", {"col": "x", "v": 3}, "colon")


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark would put a variable in the place of a dollar sign and a name in brackets
    marks = {style: mark.replace("$", "', chr(36), '") for style, mark in STYLED.items()}
    parts = [rendering.rendered(files(spark, sf_dir, f"SELECT concat('{style}/', p_partkey) AS path, concat('SELECT a', p_size, ' FROM t WHERE b = {mark}') AS source FROM part"), "placeholder", {"x": 5, "xy": 5, "1": 5}, style) for style, mark in marks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("path", "rendered")


KINDS = ("select", "join", "column_ref", "function", "alias", "table_ref", "where", "group_by", "statement")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lint_files": _found,
    "parse_statements": dialect_corpus.parse_statements,
    "lint_rules": rule_corpus.lint_rules,
    "fix_rules": rule_corpus.fix_rules,
    "lex_files": lambda spark, sf_dir: lint.tokens(files(spark, sf_dir)),
    "fix_files": lambda spark, sf_dir: lint.fixed(files(spark, sf_dir), "CV04,LT12,LT13"),
    "lint_edits": lambda spark, sf_dir: lint.edits(files(spark, sf_dir), "CV04"),
    "parse_errors": lambda spark, sf_dir: lint.parse_errors(files(spark, sf_dir, BROKEN)).select("path", "line", "pos"),
    "unused_suppressions": lambda spark, sf_dir: lint.unused_suppressions(files(spark, sf_dir), "CV05,LT05").select("path", "line"),
    "lint_annotations": lambda spark, sf_dir: lint.as_annotations(_found(spark, sf_dir)),
    "lint_json": lambda spark, sf_dir: lint.as_json(_found(spark, sf_dir)).select("path", F.json_array_length("diagnostics").alias("n")),
    "diagnostics": lambda spark, sf_dir: editor.diagnostics(_found(spark, sf_dir)),
    "semantic_tokens": lambda spark, sf_dir: editor.semantic_tokens(files(spark, sf_dir)).groupBy("path", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("units")),
    "syntax_trees": lambda spark, sf_dir: analysis.trees(files(spark, sf_dir)).where(F.col("kind").isin(*KINDS)).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")),
    "tree_descendants": lambda spark, sf_dir: analysis.descendants(analysis.trees(files(spark, sf_dir)), ["select"], ["column_ref"], ("query",)).groupBy("path").agg(F.count(F.lit(1)).alias("n")),
    "tree_ancestors": lambda spark, sf_dir: analysis.ancestors(files(spark, sf_dir), below=("column_ref",)).where(F.array_contains("kinds", "select") & (F.element_at("kinds", -1) == "column_ref")).groupBy("path").agg(F.count(F.lit(1)).alias("n")),
    "tree_kind_sets": lambda spark, sf_dir: analysis.kind_sets(files(spark, sf_dir)).where("node = 0").select("path", F.array_contains("kinds", "join").alias("joins"), F.array_contains("kinds", "comment").alias("comments"), F.array_contains("kinds", "unparsable").alias("broken")),
    "output_columns": lambda spark, sf_dir: analysis.columns(files(spark, sf_dir)),
    "lineage_graph": lambda spark, sf_dir: analysis.lineage(files(spark, sf_dir)).groupBy("path", "output").agg(F.count(F.lit(1)).alias("n"), F.max("reference").alias("reference")),
    "lineage_origins": lambda spark, sf_dir: analysis.origins(analysis.lineage(files(spark, sf_dir))),
    "qualified_sql": lambda spark, sf_dir: analysis.qualify(files(spark, sf_dir, BARE), {f"t{k}": [f"c{k}", "v"] for k in range(1, 51)} | {f"u{k}": ["id", "w"] for k in range(1, 51)}).where("step = 'qualify_outputs'").select("path", "source"),
    "query_scopes": lambda spark, sf_dir: analysis.scopes(files(spark, sf_dir, BARE)).select("path", "kind", "alias", "table", "ord"),
    "infer_tests": lambda spark, sf_dir: analysis.infer(files(spark, sf_dir), _tests(spark, sf_dir)).select("kind", "path", "column", "value", "reason"),
    "skippable_tests": lambda spark, sf_dir: analysis.skippable(files(spark, sf_dir), _tests(spark, sf_dir)).where("path LIKE 'models/%'").select("kind", "path", "column", "action"),
    "reflow_sql": lambda spark, sf_dir: layout.reflowed(files(spark, sf_dir, MESS)),
    "depth_map": lambda spark, sf_dir: layout.depths(files(spark, sf_dir)).where(F.element_at("kinds", -1) == "column_ref").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("least")),
    "render_jinja": lambda spark, sf_dir: rendering.rendered(files(spark, sf_dir, JINJA), "jinja", {"name": "tab"}).select("path", "rendered"),
    "render_styles": _styled,
    "render_format": lambda spark, sf_dir: rendering.rendered(files(spark, sf_dir, FORMATTED), "python", {"t": "tab", "n": 7}).select("path", "rendered"),
    "render_placeholders": lambda spark, sf_dir: _rendered(spark, sf_dir).select("path", "rendered"),
    "template_tokens": lambda spark, sf_dir: rendering.tokens(files(spark, sf_dir, TEMPLATES), "placeholder", {"col": "x", "v": 3}, "colon").where("slice = 'templated'").select("path", "raw", "source_start", "source_end"),
    "template_slices": lambda spark, sf_dir: rendering.slices(_rendered(spark, sf_dir)).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars")),
}


def _line(at: str) -> str:
    """The line of a place (from 1) in ``source``."""
    return f"CAST(1 + len(source[1 : {at} - 1]) - len(replace(source[1 : {at} - 1], chr(10), '')) AS INTEGER)"


def _pos(at: str) -> str:
    return f"CAST(len(regexp_extract(source[1 : {at} - 1], '[^\\n]*$')) + 1 AS INTEGER)"


_LAST = r"CASE WHEN source LIKE '%' || chr(10) THEN len(source) ELSE len(source) - len(regexp_extract(source, '\w+$')) + 1 END"
#: Violations found by string functions; ``noqa`` hides those of its line.
FOUND = f"""
WITH f AS ({MODELS}), p AS (
  SELECT path, source, 'CV04' AS code, instr(source, 'COUNT(') AS i, 'Use count(*) to express "count number of rows".' AS description FROM f WHERE regexp_matches(source, 'COUNT\\([01]\\)')
  UNION ALL SELECT path, source, 'CV05', instr(source, '= NULL'), 'Relational operators should not be used to check for NULL values.' FROM f WHERE source LIKE '%= NULL%'
  UNION ALL SELECT path, source, 'LT12', {_LAST}, 'Files must end with a single trailing newline.' FROM f WHERE NOT regexp_matches(source, '[^\\n]\\n$')
  UNION ALL SELECT path, source, 'LT13', 1, 'Files must not begin with newlines or whitespace.' FROM f WHERE source LIKE chr(10) || '%'
), l AS (
  SELECT path, unnest(string_split(source, chr(10))) AS text, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS line FROM f
), v AS (
  SELECT path, code, {_line("i")} AS line, {_pos("i")} AS pos, description FROM p
  UNION ALL SELECT path, 'LT05', CAST(line AS INTEGER), 1, concat('Line is too long (', len(text), ' > 80).') FROM l WHERE len(text) > 80
), found AS (
  SELECT v.* FROM v ANTI JOIN (SELECT * FROM l WHERE text LIKE '%-- noqa') n ON v.path = n.path AND v.line = n.line
)"""
TOKENS = f"""
WITH f AS ({MODELS}), r AS (
  SELECT path, regexp_extract_all(source, '\\n|[ \\t]+|--[^\\n]*|''[^'']*''|[A-Za-z_]\\w*|[0-9]+|.') AS x FROM f
), t AS (
  SELECT path, unnest(x) AS raw, unnest(range(len(x))) AS ord FROM r
), w AS (
  SELECT *, coalesce(sum(len(raw)) OVER before, 0) AS start, 1 + coalesce(sum(CASE WHEN raw = chr(10) THEN 1 ELSE 0 END) OVER before, 0) AS line, lag(raw) OVER (PARTITION BY path ORDER BY ord) AS prior
  FROM t WINDOW before AS (PARTITION BY path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tok AS (
  SELECT path, CAST(ord AS INTEGER) AS ord, CASE WHEN raw = chr(10) THEN 'newline' WHEN trim(raw) = '' THEN 'whitespace' WHEN raw LIKE '--%' THEN 'comment' WHEN raw LIKE '''%' THEN 'quoted_literal'
    WHEN lower(raw) IN ('select', 'as', 'from', 'inner', 'join', 'on', 'where', 'and', 'in', 'group', 'by', 'null') AND prior <> '.' THEN 'keyword' WHEN lower(raw) = 'select' THEN 'keyword' WHEN regexp_matches(raw, '^[A-Za-z_]') THEN 'word' WHEN regexp_matches(raw, '^[0-9]') THEN 'number'
    WHEN raw = '=' THEN 'comparison' WHEN raw = ',' THEN 'comma' WHEN raw = '.' THEN 'dot' WHEN raw = '(' THEN 'open' WHEN raw = ')' THEN 'close' ELSE 'operator' END AS kind,
    raw, CAST(start AS INTEGER) AS start, CAST(line AS INTEGER) AS line, CAST(start - min(start) OVER (PARTITION BY path, line) + 1 AS INTEGER) AS pos FROM w
)"""
_COUNTS = {
    "select": "1", "statement": "1", "where": "1", "group_by": "1", "join": "len(regexp_extract_all(source, ' JOIN '))", "function": "len(regexp_extract_all(source, '(COUNT|MAX)\\('))",
    "column_ref": "len(regexp_extract_all(source, '\\b[ab]\\.\\w+'))", "alias": "len(regexp_extract_all(source, ' AS '))", "table_ref": "len(regexp_extract_all(source, '(FROM|JOIN) '))",
}
_COLUMN = "regexp_extract(source, 'c[0-9]+')"
_TABLE = "regexp_extract(source, 'FROM (t[0-9]+)', 1)"

ORACLE: dict[str, str] = {
    "lint_files": f"{FOUND} SELECT * FROM found",
    "parse_statements": dialect_corpus.oracle(),
    "lint_rules": rule_corpus.oracle(),
    "fix_rules": rule_corpus.mended(),
    "lex_files": f"{TOKENS} SELECT path, ord, kind, raw, start, line, pos FROM tok",
    "fix_files": f"SELECT path, fixed AS source, CAST(fixed <> source AS INTEGER) AS changed FROM (SELECT path, source, concat(regexp_replace(trim(source, chr(10)), 'COUNT\\([01]\\)', 'COUNT(*)'), chr(10)) AS fixed FROM ({MODELS}))",
    "lint_edits": f"SELECT path, 'CV04' AS code, CAST(instr(source, 'COUNT(') + 5 AS INTEGER) AS start, CAST(instr(source, 'COUNT(') + 6 AS INTEGER) AS \"end\", '*' AS text FROM ({MODELS}) WHERE regexp_matches(source, 'COUNT\\([01]\\)')",
    "parse_errors": f"SELECT path, CAST(1 + len(source) - len(ltrim(source, chr(10))) AS INTEGER) AS line, 1 AS pos FROM ({BROKEN}) WHERE NOT source LIKE '%SELECT%'",
    "unused_suppressions": f"{FOUND} SELECT l.path, CAST(l.line AS INTEGER) AS line FROM l WHERE text LIKE '%-- noqa' AND len(text) <= 80 AND text NOT LIKE '%= NULL%'",
    "lint_annotations": f"{FOUND} SELECT format('::error title=lint,file={{}},line={{}},col={{}}::{{}}: {{}}', path, line, pos, code, description) AS line FROM found",
    "lint_json": f"{FOUND} SELECT path, CAST(count(*) AS INTEGER) AS n FROM found GROUP BY path",
    "diagnostics": f"{FOUND} SELECT path, line - 1 AS line, pos - 1 AS character, 'Warning' AS severity, code, description AS message FROM found",
    "semantic_tokens": f"{TOKENS} SELECT path, class, count(*) AS n, CAST(sum(len(raw)) AS BIGINT) AS units FROM (SELECT path, raw, CASE kind WHEN 'keyword' THEN 'keyword' WHEN 'word' THEN 'variable' WHEN 'quoted_literal' THEN 'string' WHEN 'number' THEN 'number' WHEN 'comment' THEN 'comment' WHEN 'operator' THEN 'operator' WHEN 'comparison' THEN 'operator' END AS class FROM tok) WHERE class IS NOT NULL GROUP BY path, class",
    "syntax_trees": " UNION ALL ".join(f"SELECT path, '{kind}' AS kind, CAST({how} AS BIGINT) AS n FROM ({MODELS}) WHERE {how} > 0" for kind, how in _COUNTS.items()),
    "tree_descendants": f"SELECT path, CAST({_COUNTS['column_ref']} AS BIGINT) AS n FROM ({MODELS})",
    # each reference is a name, a dot and a name
    "tree_ancestors": f"SELECT path, CAST(3 * {_COUNTS['column_ref']} AS BIGINT) AS n FROM ({MODELS})",
    "tree_kind_sets": f"SELECT path, source LIKE '%JOIN%' AS joins, source LIKE '%--%' AS comments, false AS broken FROM ({MODELS})",
    "output_columns": f"SELECT path, {_COLUMN} AS \"column\", 1 AS named FROM ({MODELS}) UNION ALL SELECT path, 'n', 1 FROM ({MODELS})",
    "lineage_graph": f"SELECT path, {_COLUMN} AS output, CAST(2 AS BIGINT) AS n, {_TABLE} AS reference FROM ({MODELS}) UNION ALL SELECT path, 'n', CASE WHEN source LIKE '%MAX(%' THEN 2 ELSE 1 END, CASE WHEN source LIKE '%MAX(%' THEN {_TABLE} ELSE '' END FROM ({MODELS})",
    "lineage_origins": f"SELECT path, {_COLUMN} AS output, {_TABLE} AS reference, {_COLUMN} AS \"column\" FROM ({MODELS}) UNION ALL SELECT path, 'n', {_TABLE}, 'v' FROM ({MODELS}) WHERE source LIKE '%MAX(%'",
    "qualified_sql": """SELECT concat('b', p_partkey) AS path, concat('WITH q AS (SELECT t', p_size, '.c', p_size, ' AS c', p_size, ', t', p_size, '.v AS v FROM t', p_size, ' AS t', p_size, ')', ' SELECT ', CASE WHEN p_partkey % 2 = 0 THEN concat('q.c', p_size, ' AS c', p_size, ', q.v AS v, _q_0.w AS w') ELSE 'q.v AS v, max(_q_0.w) AS _col_1' END, ' FROM q AS q JOIN (SELECT u', p_size, '.w AS w FROM u', p_size, ' AS u', p_size, ') AS _q_0 ON q.v = _q_0.w') AS source FROM part""",
    "query_scopes": """SELECT concat('b', p_partkey) AS path, unnest(['cte', 'source', 'root', 'source', 'source', 'derived', 'source']) AS kind, unnest([NULL, concat('t', p_size), NULL, 'q', '_q_1', NULL, concat('u', p_size)]) AS alias, unnest([NULL, concat('t', p_size), NULL, '', '', NULL, concat('u', p_size)]) AS "table", unnest([0, 1, 0, 1, 2, 0, 1]) AS ord FROM part""",
    "infer_tests": f"""SELECT 'not_null' AS kind, path, {_COLUMN} AS "column", NULL::VARCHAR AS value, 'underlying_test' AS reason FROM ({MODELS})
      UNION ALL SELECT 'greater_than', path, 'n', '0', 'underlying_test_with_operation:max' FROM ({MODELS}) WHERE source LIKE '%MAX(%'
      UNION ALL SELECT unnest(['not_null', 'greater_than_or_equal']), path, 'n', unnest([NULL, '0']), 'count_star' FROM ({MODELS}) WHERE source LIKE '%COUNT(*)%'""",
    "skippable_tests": f"SELECT 'not_null' AS kind, path, {_COLUMN} AS \"column\", 'skip' AS action FROM ({MODELS}) UNION ALL SELECT 'unique', path, 'n', 'run' FROM ({MODELS})",
    "reflow_sql": f"SELECT concat('l/', p_partkey) AS path, {TIDY} AS source FROM part",
    "depth_map": f"SELECT path, CAST(3 * {_COUNTS['column_ref']} AS BIGINT) AS n, 7 AS least FROM ({MODELS})",
    "render_jinja": "SELECT concat('j/', p_partkey) AS path, concat('SELECT ', CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END, ', ', p_size * 2 + 1, ', c', p_size, ', c7 AS z FROM TAB') AS rendered FROM part",
    "render_format": "SELECT concat('f/', p_partkey) AS path, concat('SELECT a', p_size, ', {x} FROM tab WHERE n = 007') AS rendered FROM part",
    "render_styles": " UNION ALL ".join(f"SELECT concat('{style}/', p_partkey) AS path, concat('SELECT a', p_size, ' FROM t WHERE b = 5') AS rendered FROM part" for style in STYLED),
    "render_placeholders": f"SELECT path, replace(replace(replace(source, ':col', 'x'), ':v', '3'), ':none', 'none') AS rendered FROM ({TEMPLATES})",
    "template_tokens": f"""SELECT path, p.raw, CAST(instr(replace(source, '::', '##'), p.mark) - 1 AS INTEGER) AS source_start, CAST(instr(replace(source, '::', '##'), p.mark) - 1 + len(p.mark) AS INTEGER) AS source_end
      FROM ({TEMPLATES}), (VALUES (':col', 'x'), (':v', '3'), (':none', 'none')) AS p(mark, raw) WHERE contains(source, p.mark)""",
    "template_slices": f"""WITH p AS (SELECT path, regexp_extract_all(source, '::|[^:]:(col|none|v)') AS m, string_split_regex(replace(source, '::', '##'), ':(col|none|v)') AS parts FROM ({TEMPLATES}))
      SELECT path, 'literal' AS kind, count(*) AS n, CAST(sum(len(part)) AS BIGINT) AS chars FROM (SELECT path, unnest(parts) AS part FROM p) WHERE part <> '' GROUP BY path
      UNION ALL SELECT path, 'templated', len(parts) - 1, CAST(2 + CASE WHEN len(parts) > 3 THEN 4 ELSE 0 END AS BIGINT) FROM p""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
