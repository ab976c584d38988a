"""Grouping by precedence, and numbers against DuckDB's own reading."""

import random

import duckdb
import pytest

from tessera.functions.parsing import Tree
from tessera.functions.precedence import grouped, written


def group(text):
    tree = Tree(f"SELECT {text}")
    node = next(tree.root.walk("target")).kids[0]
    return written(tree, grouped(tree, node))


@pytest.mark.parametrize(("text", "want"), [
    ("a + b * c", "(a + (b * c))"), ("a - b - c", "((a - b) - c)"), ("a or b and not c = d", "(a or (b and (not (c = d))))"), ("-a * b", "((- a) * b)"), ("a between 1 and 2 and b", "((a between 1 between 2) and b)"),
    ("a not in (1, 2) or b is not null", "((not (a in (1, 2))) or (not (b is null)))"), ("a || b || c like 'x' escape '!'", "(((a || b) || c) like 'x' like '!')"), ("a::int + b[1]::text", "((a :: int) + ((b [ [1]) :: text))"), ("(a + b) * c", "((a + b) * c)"),
    ("a & b | c ^ d << 2", "((a & b) | (c ^ (d << 2)))"), ("a is distinct from b + 1", "(a is distinct from (b + 1))"), ("not exists (select 1)", "(not (exists (select 1)))"), ("a at time zone 'x' > b", "((a at time zone 'x') > b)"),
])
def test_grouping(text, want):
    assert group(text) == want


@pytest.mark.parametrize("bad", ["a + ", "a between 1", "* +"])
def test_errors(bad):
    with pytest.raises((ValueError, StopIteration)):
        group(bad)


def test_numbers_agree():
    rng = random.Random(3)

    def text(depth):
        if depth == 0 or rng.random() < 0.2:
            return str(rng.randint(1, 9))
        kind = rng.random()
        if kind < 0.15:
            return f"({text(depth - 1)})"
        if kind < 0.25:
            return f"- {text(0)}"
        return f"{text(depth - 1)} {rng.choice(['+', '-', '*', '=', '<', '>='])} {text(depth - 1)}" if kind < 0.5 else f"{text(depth - 1)} {rng.choice(['+', '-', '*'])} {text(depth - 1)}"

    c, seen = duckdb.connect(), 0
    for _ in range(300):
        t = text(3)
        if sum(t.count(x) for x in ("=", "<", ">")) > 1:
            continue
        try:
            want = c.sql(f"SELECT {t}").fetchall()
        except duckdb.Error:  # a truth value where a number is due
            continue
        seen += 1
        assert want == c.sql(f"SELECT {group(t)}").fetchall(), (t, group(t))
    assert seen > 100
