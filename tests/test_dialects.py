"""Statements of each dialect, written here, and what must not pass."""

import pytest

from tessera import dialects
from tessera.functions import grammar
from tessera.functions.parsing import Tree
from tessera.operators import analysis, lint
from tessera.plans.dialect_corpus import TEXTS

@pytest.mark.parametrize("dialect", dialects.NAMES)
def test_reads_its_statements(dialect):
    for sql in TEXTS[dialect]:
        tree = Tree(sql, dialect)
        assert not [tree.raw(n) for n in tree.root.walk("unparsable")], sql
        assert "".join(r[7] for r in tree.rows() if r[7] is not None) == sql


@pytest.mark.parametrize("dialect", dialects.NAMES)
def test_grammar_is_whole(dialect):
    g = dialects.grammar(dialect)
    assert not g.missing(dialects.TERMINALS)
    for body in g.bodies.values():
        grammar._Reader(g, body).whole()


@pytest.mark.parametrize("sql", ["SELEC a FRM t", "CREATE TABLE ((((garbage", "INSERT t VALUES", "DROP TABLE", "ALTER TABLE t FROB c", "UPDATE SET a = 1", "GRANT ON t TO u", "CREATE INDEX ON (a)", "MERGE INTO t USING s", "DELETE t FROM WHERE", "REVOKE SELECT ON t TO u", "CREATE VIEW v AS", "EXPLAIN", "CREATE SEQUENCE", "TRUNCATE"])
def test_refuses_nonsense(sql):
    assert list(Tree(sql).root.walk("unparsable"))


def test_changes_within_queries():
    sql = "WITH gone AS (DELETE FROM t WHERE a = 1 RETURNING b), n (x) AS (SELECT 1) SELECT b, x FROM gone, n\n"
    assert not list(Tree(sql, "postgres").root.walk("unparsable"))
    assert analysis.output_columns(sql, "postgres") == (["b", "x"], [])
    assert not [x for x in lint.lint_text(sql, lint.selected("all"), "postgres") if "exception" in x[3]]


def test_what_began_well_keeps_its_tree():
    tree = Tree("DROP TABLE a CASCADE nonsense here; SELECT 1")
    first, second = tree.root.children("statement")
    assert first.child("drop_statement").child("drop_table") and [tree.raw(n) for n in first.walk("unparsable")] == ["nonsense here"]
    assert not list(second.walk("unparsable"))


def test_statements_of_another_dialect_are_refused():
    for dialect, sql in [("ansi", TEXTS["snowflake"][3]), ("postgres", TEXTS["mysql"][2]), ("sqlite", TEXTS["hive"][2]), ("mysql", TEXTS["postgres"][3]), ("ansi", TEXTS["clickhouse"][2])]:
        assert list(Tree(sql, dialect).root.walk("unparsable")), (dialect, sql)
    with pytest.raises(dialects.UnknownDialect):
        Tree("SELECT 1", "klingon")


def match(text, rule, tokens, flags=frozenset()):
    low = tokens.lower().split()
    kinds = [{"(": "open", ")": "close", ",": "comma", ";": "semicolon"}.get(t, "word") for t in low]
    g = grammar.Grammar(text, flags=flags)
    got = g.match(grammar.Run(low, kinds, {}, g.flags, len(low)), rule, 0)
    return got and got.end


def test_notation():
    assert match("r = A B? C", "r", "a c") == 2 and match("r = A B? C", "r", "a b b c") is None
    assert match("r = A | A B | A B C D", "r", "a b c") == 2  # the longest of those that match
    assert match("r = A % \",\"", "r", "a , a , b") == 3 and match("r = A %? \",\"", "r", "a , a ,") == 4
    assert match("r = &( A | B | C )", "r", "c a x") == 2 and match("r = &( A | B )", "r", "a a") == 1
    assert match("r = X < A* > Y", "r", "x ( a a ) y") == 6 and match("r = X < A > Y", "r", "x ( a a ) y") is None
    assert match("r = A ... ", "r", "a ( ; ) b ; c") == 5 and match("r = ..( B ) B", "r", "x ( b ) b") == 5
    assert match("r = !A B", "r", "b") == 1 and match("r = !B B", "r", "b") is None
    assert match("r = A @on( B )?", "r", "a b") == 1 and match("r = A @on( B )?", "r", "a b", frozenset(("on",))) == 2
    base = grammar.Grammar("r = A\ns = r r")
    more = grammar.Grammar("r += B", base)
    run = lambda g: g.match(grammar.Run(["a", "b"], ["word"] * 2, {}, g.flags, 2), "s", 0)
    assert run(base) is None and run(more).end == 2
    for bad in ("r = (A", "r = A )", "r = ?", "+ r"):
        with pytest.raises(ValueError):
            match(bad, "r", "a")
    with pytest.raises(ValueError):
        grammar.Grammar("q += A", base)
