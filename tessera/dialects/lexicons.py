"""How the dialects quote, comment and write parameters, and what their queries have beyond the common clauses."""

from __future__ import annotations

from typing import NamedTuple


class Lexicon(NamedTuple):
    base: str | None
    literal: tuple[str, ...] = ("'",)
    identifier: tuple[str, ...] = ('"', "`")
    #: A backslash escapes in literals.
    backslash: bool = False
    #: Comments that begin with one of these, besides ``--``.
    comments: tuple[str, ...] = ()
    #: ``[name]`` is an identifier.
    square: bool = False
    #: Letters that may stand before a literal; those in ``escaping`` make a backslash escape in it.
    prefixes: str = "nNxXbB"
    escaping: str = ""
    #: Strings between three quotes.
    triple: bool = False
    #: Strings between ``$tag$`` marks.
    dollar: bool = False
    #: What names may hold besides letters, digits, "_" and "$".
    letters: str = ""
    #: Parameters and variables.
    parameter: str = ""
    #: Words with which clauses begin that only this dialect's queries have: (first, second or "" for any).
    clauses: tuple[tuple[str, str], ...] = ()


LOCKING = (("for", "update"), ("for", "share"), ("for", "no"), ("for", "key"))

LEXICONS: dict[str, Lexicon] = {
    "ansi": Lexicon(None, comments=("#",), clauses=(("for", "update"),)),
    "athena": Lexicon("ansi", comments=("#",)),
    "bigquery": Lexicon("ansi", ("'", '"'), ("`",), True, ("#",), prefixes="rRbB", triple=True, parameter=r"@@?[\w.]+|\?"),
    "clickhouse": Lexicon("ansi", backslash=True, comments=("#",), parameter=r"\{\w+:[^{}]+\}", clauses=(("prewhere", ""), ("settings", ""), ("format", ""), ("array", "join"), ("into", "outfile"), ("sample", ""))),
    "databricks": Lexicon("sparksql", ("'", '"'), ("`",), True, prefixes="rRxX", parameter=r":\w+|\?"),
    "db2": Lexicon("ansi", letters="#", clauses=(("with", "ur"), ("with", "cs"), ("with", "rs"), ("with", "rr"), ("optimize", "for"), ("for", "update"), ("for", "read"))),
    "duckdb": Lexicon("postgres", identifier=('"',), dollar=True, escaping="eE", parameter=r"\$\w+|\?\d*", clauses=(("using", "sample"),)),
    "exasol": Lexicon("ansi", identifier=('"',), square=True, letters="#", clauses=(("preferring", ""), ("connect", "by"), ("start", "with"))),
    "greenplum": Lexicon("postgres", identifier=('"',), dollar=True, escaping="eE", parameter=r"\$\d+", clauses=LOCKING),
    "hive": Lexicon("ansi", ("'", '"'), ("`",), True, parameter=r"\$\{[\w:.]+\}"),
    "materialize": Lexicon("postgres", identifier=('"',), dollar=True, escaping="eE", parameter=r"\$\d+", clauses=(("as", "of"), ("options", ""))),
    "mysql": Lexicon("ansi", ("'", '"'), ("`",), True, ("#",), parameter=r"@@?[\w.`]+|\?", clauses=(*LOCKING, ("lock", "in"), ("into", "outfile"), ("into", "dumpfile"), ("procedure", ""))),
    "oracle": Lexicon("ansi", identifier=('"',), letters="#", parameter=r":\w+|&&?\w+\.?", clauses=(("connect", "by"), ("start", "with"), ("model", ""), *LOCKING)),
    "postgres": Lexicon("ansi", identifier=('"',), dollar=True, escaping="eE", parameter=r"\$\d+", clauses=LOCKING),
    "redshift": Lexicon("postgres", identifier=('"',), dollar=True, escaping="eE", parameter=r"\$\d+|#\w+", clauses=(("connect", "by"), ("start", "with"))),
    "snowflake": Lexicon("ansi", ("'",), ('"',), True, ("//", "#"), dollar=True, parameter=r"\$\w+|:\w+|\?", clauses=(("connect", "by"), ("start", "with"), ("at", "("), ("before", "("), ("match_recognize", "("))),
    "sparksql": Lexicon("hive", ("'", '"'), ("`",), True, prefixes="rRxX", parameter=r"\$\{[\w:.]+\}|:\w+|\?"),
    "sqlite": Lexicon("ansi", square=True, prefixes="xX", parameter=r"[@:$]\w+|\?\d*"),
    "starrocks": Lexicon("mysql", ("'", '"'), ("`",), True, ("#",), parameter=r"@@?[\w.`]+|\?", clauses=LOCKING),
    "teradata": Lexicon("ansi", identifier=('"',), parameter=r":\w+|\?", clauses=(("sample", ""), ("expand", "on"), ("normalize", ""))),
    "trino": Lexicon("ansi", identifier=('"',), prefixes="xXuU", parameter=r"\?"),
    "tsql": Lexicon("ansi", identifier=('"',), square=True, letters="#", prefixes="nN", parameter=r"@@?\w+|\$\(\w+\)|##?\w+", clauses=(("option", "("), ("for", "xml"), ("for", "json"), ("for", "browse"))),
}
