"""Scopes, column lineage, output columns and inference of column assertions, for SQL texts as rows.

The work on a text is local to its row; relations over all texts (which models read a column, what to skip) are joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import SHAPES, Node, Tree

AGGREGATES = ("avg", "min", "max")
#: How deep registered sources may stand in each other.
DEPTH = 32
#: About as many rows of ancestors are sent at once.
BATCH_ROWS = 20000


def plain(name: str) -> str:
    return name[1:-1] if len(name) > 1 and name[0] in "\"`[" else name


@dataclass
class Column:
    """An output of a query or a column of a table, with the columns it is made from."""

    name: str
    expression: str
    made: str  # "column", "expression", "star", "union", "table", "count_star" or an aggregate
    parents: list[Column] = field(default_factory=list)
    source_name: str = ""
    reference: str = ""
    named: bool = True
    grouped: bool = False


@dataclass
class Source:
    alias: str
    columns: list[Column] | None  # None: unknown
    table: str = ""
    outer: bool = False  # rows may be missing, so that its columns may be null
    made: dict[str, Column] = field(default_factory=dict)

    def get(self, name: str) -> Column | None:
        if self.columns is not None:
            return next((c for c in self.columns if c.name.lower() == name.lower()), None)
        if name.lower() not in self.made:
            self.made[name.lower()] = Column(name, self.table, "table", source_name=self.alias, reference=self.table)
        return self.made[name.lower()]


class Scopes:
    """Resolves the outputs of a query; ``schema`` names the columns of tables, ``views`` the SQL behind table names."""

    def __init__(self, schema: dict[str, list[str]] | None = None, views: dict[str, str] | None = None, dialect: str = "ansi"):
        self.schema = {k.lower(): v for k, v in (schema or {}).items()}
        self.views = {k.lower(): v for k, v in (views or {}).items()}
        self.dialect, self.depth = dialect, 0
        self.joins: list[str] = []
        #: (tree, select, its sources, those around it) of every select in the order they were resolved.
        self.seen: list[tuple[Tree, Node, list[Source], list[Source]]] = []

    def of_text(self, sql: str) -> list[Column]:
        tree = Tree(sql, self.dialect)
        statements = tree.root.children("statement")
        if not statements or list(statements[-1].walk("unparsable")):
            raise ValueError("the last statement can't be parsed")
        query = next(statements[-1].walk("query"), None)
        if query is None:
            raise ValueError("the last statement has no query")
        return self.query(tree, query, {}, [])

    def query(self, tree: Tree, q: Node, ctes: dict[str, Source], outer: list[Source]) -> list[Column]:
        ctes = dict(ctes)
        for cte in q.children("cte"):
            if cte.child("name") is None:
                continue
            name = plain(tree.raw(cte.child("name")))
            body = cte.child("query")
            own = cte.child("column_list")
            if body is None:  # a statement that changes rows, or a value: its outputs aren't followed
                ctes[name.lower()] = Source(name, None, name)
                continue
            names = [plain(tree.raw(k)) for k in own.kids] if own else None
            if names:  # a recursive reference knows its names
                ctes[name.lower()] = Source(name, [Column(n, "", "expression", source_name=name) for n in names])
            else:
                ctes.setdefault(name.lower(), Source(name, None, name))
            found = self.query(tree, body, ctes, outer)
            for c, n in zip(found, names or (), strict=False):
                c.name = n
            ctes[name.lower()] = Source(name, found)
        body = q.child("select", "set_expression", "bracketed_query", "values")
        return self.body(tree, body, ctes, outer)

    def body(self, tree: Tree, n: Node, ctes: dict[str, Source], outer: list[Source]) -> list[Column]:
        if n.kind == "bracketed_query":
            return self.query(tree, n.child("query"), ctes, outer)
        if n.kind == "values":
            first = n.kids[0].child("bracketed")
            width = len(first.kids) if first else 1
            return [Column(f"col{i + 1}", tree.raw(n), "expression") for i in range(width)]
        if n.kind == "set_expression":
            sides = [self.body(tree, k, ctes, outer) for k in n.kids if k.kind != "set_operator"]
            return [Column(c.name, tree.raw(n), "union", [s[i] for s in sides if i < len(s)], named=c.named) for i, c in enumerate(sides[0])]
        return self.select(tree, n, ctes, outer)

    def sources(self, tree: Tree, select: Node, ctes: dict[str, Source], outer: list[Source]) -> list[Source]:
        out: list[Source] = []

        def add(s: Node, missing: bool) -> None:
            inner, alias = s.kids[0], s.child("alias")
            named = alias.child("name") if alias else None
            name = plain(tree.raw(named)) if named else ""
            if inner.kind == "derived":
                cols = self.query(tree, inner.child("query"), ctes, [*out, *outer])
                source = Source(name or f"_q_{len(out)}", cols)
            elif inner.kind == "nested_from":
                for k in inner.kids:
                    item(k)
                return
            elif inner.kind == "table_ref":
                raw = ".".join(plain(p) for p in tree.raw(inner).split("."))
                known = ctes.get(raw.lower())
                if known is not None:
                    source = Source(name or raw, known.columns, known.table)
                elif raw.lower() in self.views and self.depth < DEPTH:
                    self.depth += 1
                    source = Source(name or raw.rpartition(".")[2], Scopes.of_text(self, self.views[raw.lower()]))
                    self.depth -= 1
                else:
                    cols = self.schema.get(raw.lower())
                    source = Source(name or raw.rpartition(".")[2], None, raw)
                    if cols is not None:
                        source.columns = [Column(c, raw, "table", source_name=source.alias, reference=raw) for c in cols]
            else:
                source = Source(name or tree.raw(inner), None, tree.raw(inner))
            listed = alias.child("column_list") if alias else None
            if listed and source.columns is not None:
                source.columns = [Column(plain(tree.raw(k)), c.expression, "column", [c]) for k, c in zip(listed.kids, source.columns, strict=False)]
            source.outer = missing
            out.append(source)

        def item(k: Node) -> None:
            if k.kind == "source":
                add(k, False)
            elif k.kind == "join":
                how = " ".join(w for w in tree.low[k.child("join_type").lo : k.child("join_type").hi] if w not in ("join", "outer"))
                self.joins.append(how or "inner")
                if how in ("right", "full"):
                    for s in out:
                        s.outer = True
                add(k.child("source"), how in ("left", "full", "natural left", "natural full"))
            elif k.kind == "lateral_view":
                alias = k.child("alias")
                out.append(Source(plain(tree.raw(alias.child("name"))) if alias else "", [], tree.raw(k.kids[0])))

        clause = select.child("from_clause")
        for k in clause.kids if clause else ():
            item(k)
        return out

    def resolve(self, name: str, sources: list[Source], outer: list[Source]) -> Column | None:
        parts = [plain(p) for p in name.split(".")]
        for group in (sources, outer):
            if len(parts) > 1:
                for s in group:
                    if s.alias.lower() == parts[-2].lower() or s.table and s.table.lower() == ".".join(parts[:-1]).lower():
                        return s.get(parts[-1])
                for s in group:  # a field of a column
                    if s.alias.lower() != parts[0].lower() and s.columns is not None and (found := s.get(parts[0])):
                        return found
            else:
                having = [s for s in group if s.columns is not None and s.get(parts[0])]
                unknown = [s for s in group if s.columns is None]
                if len(having) == 1:
                    return having[0].get(parts[0])
                if not having and len(unknown) == 1:
                    return unknown[0].get(parts[0])
        return None

    def references(self, tree: Tree, e: Node, ctes: dict[str, Source], sources: list[Source], outer: list[Source]) -> list[Column]:
        found: list[Column] = []
        for k in e.walk("column_ref", "query", into=lambda n: n.kind != "query"):
            got = self.resolve(tree.raw(k), sources, outer)
            if got is not None:
                found.append(got)
        for k in e.kids:
            found += self.inner_queries(tree, k, ctes, [*sources, *outer])
        return list({id(c): c for c in found}.values())

    def inner_queries(self, tree: Tree, n: Node, ctes: dict[str, Source], outer: list[Source]) -> list[Column]:
        if n.kind == "query":
            return self.query(tree, n, ctes, outer)
        return [c for k in n.kids for c in self.inner_queries(tree, k, ctes, outer)]

    def select(self, tree: Tree, select: Node, ctes: dict[str, Source], outer: list[Source]) -> list[Column]:
        sources = self.sources(tree, select, ctes, outer)
        self.seen.append((tree, select, sources, outer))
        clause, out = select.child("select_clause"), []
        for k in select.kids:  # queries in conditions have scopes too, though no output comes from them
            if k.kind not in ("select_clause", "from_clause"):
                self.inner_queries(tree, k, ctes, [*sources, *outer])
        grouped = select.child("group_by") is not None
        missing = {id(c) for s in sources if s.outer for c in (s.columns or ())}
        for target in clause.children("target") if clause else ():
            value, alias = target.kids[0], target.child("alias")
            star = value.child("star")
            if star and value.kids[0] is star:
                prefix = tree.raw(star).rpartition(".")[0]
                modifier = value.child("star_modifier")
                gone = {plain(tree.raw(k)).lower() for k in modifier.walk("column_ref")} if modifier and tree.low[modifier.lo - 1] in ("except", "exclude") else set()
                for s in sources:
                    if prefix and s.alias.lower() != plain(prefix.rpartition(".")[2]).lower() and s.table.lower() != prefix.lower():
                        continue
                    if s.columns is None:
                        out.append(Column("*", tree.raw(star), "star", [Column("*", s.table, "table", source_name=s.alias, reference=s.table)]))
                    else:
                        out += [Column(c.name, c.name, "column" if not s.outer else "expression", [c], s.alias, s.table) for c in s.columns if c.name.lower() not in gone]
                continue
            named = alias.child("name") if alias else None
            only = value.kids[0] if len(value.kids) == 1 and (value.kids[0].lo, value.kids[0].hi) == (value.lo, value.hi) else None
            parents = self.references(tree, value, ctes, sources, outer)
            made = "expression"
            if only and only.kind == "column_ref":
                made = "column"
            elif only and only.kind == "function" and len(only.kids) == 2:
                call, inside = tree.low[only.lo], [k for k in only.kids[1].kids if k.hi > k.lo]
                if call == "count" and len(inside) == 1 and tree.raw(inside[0]) == "*":
                    made = "count_star"
                elif call in AGGREGATES and len(inside) == 1 and [k.kind for k in inside[0].kids] == ["column_ref"] and inside[0].hi - inside[0].lo == inside[0].kids[0].hi - inside[0].kids[0].lo:
                    made = call
            nullable = any(id(p) in missing or any(p is c for s in sources if s.outer for c in s.made.values()) for p in parents)
            name = plain(tree.raw(named)) if named else plain(tree.raw(value).rpartition(".")[2]) if made == "column" else tree.raw(value)
            out.append(Column(name, tree.raw(value), "expression" if nullable and made != "count_star" else made, parents, named=bool(named) or made == "column", grouped=grouped))
        return out


QUALIFY_STEPS = ("expand_sources", "qualify_tables", "qualify_columns", "expand_stars", "qualify_outputs")


def qualified(sql: str, schema: dict[str, list[str]] | None = None, views: dict[str, str] | None = None, dialect: str = "ansi") -> dict[str, str]:
    """The text after each step of qualification: views in the place of their names, an alias for every source (``_q_N``
    where there is none), the source of every column that only one exposes, columns for stars, names for outputs."""
    out, text = {}, sql
    for step in QUALIFY_STEPS:
        for _ in range(DEPTH if step == "expand_sources" else 1):
            scopes = Scopes(schema, {} if step == "expand_sources" else None, dialect)
            scopes.of_text(text)
            edits = [e for tree, select, sources, outer in scopes.seen for e in _STEPS[step](scopes, tree, select, sources, outer, views or {})]
            if not edits:
                break
            for a, b, new in sorted(set(edits), key=lambda e: (e[0], e[1]), reverse=True):
                text = text[:a] + new + text[b:]
        out[step] = text
    return out


def _place(tree: Tree, n: Node) -> tuple[int, int]:
    return tree.code[n.lo].start, tree.code[n.hi - 1].start + len(tree.code[n.hi - 1].raw)


def _own(n: Node | None, *kinds: str) -> Iterator[Node]:
    return (k for k in n.walk(*kinds, into=lambda x: x.kind != "query") if k is not n) if n is not None else iter(())


def _expand_sources(scopes: Scopes, tree: Tree, select: Node, sources: list[Source], outer: list[Source], views: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    known = {k.lower(): v for k, v in views.items()}
    ctes = {plain(tree.raw(c.child("name"))).lower() for c in tree.root.walk("cte") if c.child("name")}
    for s in _own(select.child("from_clause"), "source"):
        inner = s.kids[0]
        name = ".".join(plain(p) for p in tree.raw(inner).split(".")) if inner.kind == "table_ref" else ""
        if name and name.lower() in known and name.lower() not in ctes:
            a, b = _place(tree, inner)
            yield a, b, f"({known[name.lower()].strip().rstrip(';')})" + ("" if s.child("alias") else f" AS {name.rpartition('.')[2]}")


def _qualify_tables(scopes: Scopes, tree: Tree, select: Node, sources: list[Source], outer: list[Source], views: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    n = 0
    for s in _own(select.child("from_clause"), "source"):
        inner, alias = s.kids[0], s.child("alias")
        if alias and alias.child("name") or inner.kind not in ("table_ref", "derived"):
            continue
        b = _place(tree, inner)[1]
        if inner.kind == "table_ref":
            yield b, b, f" AS {tree.raw(inner).rpartition('.')[2]}"
        else:
            yield b, b, f" AS _q_{n}"
            n += 1


def _qualify_columns(scopes: Scopes, tree: Tree, select: Node, sources: list[Source], outer: list[Source], views: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    outputs = {plain(tree.raw(t.child("alias").child("name"))).lower() for t in _own(select.child("select_clause"), "target") if t.child("alias") and t.child("alias").child("name")}
    using = {id(k) for j in _own(select.child("from_clause"), "using") for k in j.walk("column_ref")}
    for r in _own(select, "column_ref"):
        raw = tree.raw(r)
        late = any(k.kind in ("order_by", "group_by", "having", "qualify") and k.lo <= r.lo < k.hi for k in select.kids)
        if "." in raw or id(r) in using or late and plain(raw).lower() in outputs:
            continue
        having = [s for s in sources if s.columns is not None and s.get(plain(raw))]
        unknown = [s for s in sources if s.columns is None]
        found = having[0] if len(having) == 1 else unknown[0] if not having and len(unknown) == len(sources) == 1 else None
        if found is not None and found.alias:
            a, b = _place(tree, r)
            yield a, b, f"{found.alias}.{raw}"


def _expand_stars(scopes: Scopes, tree: Tree, select: Node, sources: list[Source], outer: list[Source], views: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    for t in _own(select.child("select_clause"), "target"):
        star = t.kids[0].child("star")
        if star is None or t.kids[0].kids[0] is not star:
            continue
        prefix = plain(tree.raw(star).rpartition(".")[0].rpartition(".")[2]).lower()
        meant = [s for s in sources if not prefix or s.alias.lower() == prefix]
        if not meant or any(s.columns is None for s in meant):
            continue
        modifier = t.kids[0].child("star_modifier")
        gone = {plain(tree.raw(k)).lower() for k in modifier.walk("column_ref")} if modifier else set()
        a, b = _place(tree, t)
        yield a, b, ", ".join(f"{s.alias}.{c.name} AS {c.name}" for s in meant for c in s.columns if c.name.lower() not in gone)


def _qualify_outputs(scopes: Scopes, tree: Tree, select: Node, sources: list[Source], outer: list[Source], views: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    for i, t in enumerate(_own(select.child("select_clause"), "target")):
        value = t.kids[0]
        if t.child("alias") or not value.kids or value.kids[0].kind == "star":
            continue
        only = len(value.kids) == 1 and (value.kids[0].lo, value.kids[0].hi) == (value.lo, value.hi) and value.kids[0].kind == "column_ref"
        b = _place(tree, t)[1]
        yield b, b, f" AS {tree.raw(value).rpartition('.')[2] if only else f'_col_{i}'}"


_STEPS = {"expand_sources": _expand_sources, "qualify_tables": _qualify_tables, "qualify_columns": _qualify_columns, "expand_stars": _expand_stars, "qualify_outputs": _qualify_outputs}


def qualify(files: DataFrame, schema: dict[str, list[str]] | None = None, views: dict[str, str] | None = None, dialect: str = "ansi") -> DataFrame:
    """(path, step, source): each text after each step of qualification."""
    return _table(files, "path string, step string, source string", lambda _, s: list(qualified(s, schema, views, dialect).items())).where("step IS NOT NULL")


def scope_rows(sql: str, schema: dict[str, list[str]] | None = None, dialect: str = "ansi") -> list[tuple]:
    """(scope, kind, source, table, place) of each source of each select; a scope is told by the place of its select."""
    scopes, rows = Scopes(schema, None, dialect), []
    scopes.of_text(sql)
    for tree, select, sources, outer in scopes.seen:
        within = next((n.kind for n in reversed(_above(tree.root, select)) if n.kind in ("cte", "derived", "subquery", "set_expression")), "root")
        at = tree.code[select.lo].start
        rows.append((at, within, None, None, 0))
        rows += [(at, "source" if s.table or s.columns is not None else "function", s.alias, s.table, k + 1) for k, s in enumerate(sources)]
    return sorted(rows, key=lambda r: (r[0], r[4]))


def _above(root: Node, target: Node) -> list[Node]:
    for k in root.kids:
        if k is target:
            return [root]
        if k.lo <= target.lo and target.hi <= k.hi and (found := _above(k, target)):
            return [root, *found]
    return []


def scopes(files: DataFrame, schema: dict[str, list[str]] | None = None, dialect: str = "ansi") -> DataFrame:
    """(path, scope, kind, alias, table, ord): the scopes of each text (root, cte, derived, subquery, set) and their sources."""
    return _table(files, "path string, scope int, kind string, alias string, table string, ord int", lambda _, s: scope_rows(s, schema, dialect)).where("scope IS NOT NULL")


def output_columns(sql: str, dialect: str = "ansi") -> tuple[list[str], list[str]]:
    """(named, unnamed) outputs of the last statement."""
    found = Scopes(dialect=dialect).of_text(sql)
    return [c.name for c in found if c.named and c.made != "star"], [c.name for c in found if not c.named]


def lineage_rows(sql: str, schema: dict[str, list[str]] | None = None, views: dict[str, str] | None = None, dialect: str = "ansi") -> list[tuple]:
    """(output, node, parent, name, expression, source_name, reference) of the nodes of all outputs' graphs, as trees."""
    rows: list[tuple] = []
    for column in Scopes(schema, views, dialect).of_text(sql):
        todo = [(column, None, 0)]
        while todo:
            c, parent, depth = todo.pop()
            name = "UNION" if c.made == "union" else f"{c.source_name}.{c.name}" if c.source_name else c.name
            rows.append((column.name, len(rows), parent, name, c.expression, c.source_name, c.reference))
            if depth < 200:
                todo += [(p, len(rows) - 1, depth + 1) for p in reversed(c.parents)]
    return rows


LINEAGE = "path string, output string, node int, parent int, name string, expression string, source_name string, reference string"


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cores: a small file of paths or keys, that a table of long work is made from, is one split."""
    return df.select("path", "source").repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _table(df: DataFrame, schema: str, of) -> DataFrame:
    """``of(source)`` for each row; a text that it refuses gives one row with nulls but for its path."""
    kinds = {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, *r) for r in of(path, source or "")]
                except (ValueError, RecursionError):
                    rows.append((path, *[None] * (len(fields) - 1)))
            cols = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    return spread(df).mapInArrow(run, schema)


def trees(files: DataFrame, dialect: str = "ansi") -> DataFrame:
    """All nodes and tokens; descendants of a node are the rows of its path with ``pre`` from its own to its ``post``."""
    return _table(files, "path string, node int, parent int, ord int, kind string, pre int, post int, depth int, raw string, start int, line int, pos int", lambda _, s: Tree(s, dialect).rows())


class _Form:
    """A tree by the kinds of its rows alone: a key for a cache of what follows from these."""

    __slots__ = ("tree", "kinds")

    def __init__(self, tree: Tree):
        self.tree, self.kinds = tree, tuple(t.kind for t in tree.tokens)

    def __hash__(self) -> int:
        return hash((id(self.tree.root), self.kinds))

    def __eq__(self, other: object) -> bool:
        # texts of a shape share the root, which the cache keeps alive
        return isinstance(other, _Form) and self.tree.root is other.tree.root and self.kinds == other.kinds


_ABOVE = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()))


@lru_cache(maxsize=SHAPES // 4)
def _ancestors(form: _Form, below: tuple[str, ...]) -> pa.RecordBatch:
    rows, stacks, found = form.tree.rows(), {}, []
    for node, parent, _, kind, *_ in rows:
        stacks[node] = ([], []) if parent is None else ([*stacks[parent][0], parent], [*stacks[parent][1], rows[parent][3]])
        if not below or stacks[node][1] and stacks[node][1][-1] in below:
            found.append((node, *stacks[node]))
    cols = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _ABOVE, strict=True)], ["node", "above", "kinds"])


def ancestors(files: DataFrame, dialect: str = "ansi", below: tuple[str, ...] = ()) -> DataFrame:
    """(path, node, above, kinds): the nodes above each node and token from the root down, and their kinds, in one pass;
    with ``below`` only of what is right below a node of these kinds."""

    refused = pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in _ABOVE], ["node", "above", "kinds"])

    def of(source: str) -> pa.RecordBatch:
        try:
            tree = Tree(source, dialect)
            return (_ancestors if tree.shared else _ancestors.__wrapped__)(_Form(tree), below)
        except (ValueError, RecursionError):
            return refused

    def joined(paths: list[str], found: list[pa.RecordBatch]) -> pa.RecordBatch:
        counts = np.repeat(np.arange(len(found)), [f.num_rows for f in found])
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()).take(pa.array(counts)), *(pa.concat_arrays([f.column(i) for f in found]) for i in range(3))], ["path", "node", "above", "kinds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found, n = [], [], 0
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths.append(path)
                found.append(of(source or ""))
                n += found[-1].num_rows
                if n >= BATCH_ROWS:
                    yield joined(paths, found)
                    paths, found, n = [], [], 0
            if found:
                yield joined(paths, found)

    return spread(files).mapInArrow(run, "path string, node int, above array<int>, kinds array<string>")


def kind_sets(files: DataFrame, dialect: str = "ansi") -> DataFrame:
    """(path, node, kinds): the sorted kinds of what is in each node, its own included; rules prune by them."""

    def of(_: str, source: str) -> list[tuple]:
        rows = Tree(source, dialect).rows()
        found: list[set[str]] = [{r[3]} for r in rows]
        for node, parent, *_ in reversed(rows):
            if parent is not None:
                found[parent] |= found[node]
        return [(node, sorted(found[node])) for node, *_ in rows]

    return _table(files, "path string, node int, kinds array<string>", of)


def descendants(nodes: DataFrame, of: list[str], kinds: list[str], but: tuple[str, ...] = ()) -> DataFrame:
    """(path, ancestor, node, kind): nodes of ``kinds`` below nodes of kinds ``of``, with none of kinds ``but`` between."""
    a = nodes.where(F.col("kind").isin(of)).select("path", F.col("node").alias("ancestor"), F.col("pre").alias("__lo"), F.col("post").alias("__hi"))
    d = nodes.where(F.col("kind").isin(kinds)).select("path", "node", "kind", F.col("pre").alias("__at"))
    met = d.join(a, "path").where("__at > __lo AND __at <= __hi")
    if but:
        wall = nodes.where(F.col("kind").isin(list(but))).select(F.col("path").alias("__p"), F.col("pre").alias("__wl"), F.col("post").alias("__wh"))
        met = met.join(wall, (F.col("path") == F.col("__p")) & (F.col("__wl") > F.col("__lo")) & (F.col("__wl") < F.col("__at")) & (F.col("__wh") >= F.col("__at")), "left_anti")
    return met.select("path", "ancestor", "node", "kind")


def lineage(files: DataFrame, schema: dict[str, list[str]] | None = None, views: dict[str, str] | None = None, dialect: str = "ansi") -> DataFrame:
    """Lineage of all outputs of each text; ``schema`` and ``views`` go to every task, so they are as small as a catalog."""
    return _table(files, LINEAGE, lambda _, s: lineage_rows(s, schema, views, dialect))


def origins(found: DataFrame) -> DataFrame:
    """(path, output, reference, column): the table columns that each output comes from."""
    return found.where("reference <> ''").select("path", "output", "reference", F.element_at(F.split("name", "\\."), -1).alias("column")).distinct()


def columns(files: DataFrame, dialect: str = "ansi") -> DataFrame:
    def of(_: str, s: str) -> list[tuple]:
        named, unnamed = output_columns(s, dialect)
        return [(c, 1) for c in named] + [(c, 0) for c in unnamed]

    return _table(files, "path string, column string, named int", of)


MAPPED = "path string, column string, how string, source string, source_column string, grouped int"


def column_map(files: DataFrame, dialect: str = "ansi") -> DataFrame:
    """(path, column, how, source, source_column, grouped): outputs that are columns, aggregates of columns or counts, with the
    table column behind them, through derived tables and common table expressions."""

    def of(_: str, s: str) -> list[tuple]:
        scopes, rows = Scopes(dialect=dialect), []
        found = scopes.of_text(s)
        if any(j not in ("inner", "left") for j in scopes.joins) or {"inner", "left"} <= set(scopes.joins):
            raise ValueError("only inner joins or only left joins can be inferred through")
        for c in found:
            how, at = c.made, c
            if how == "count_star":
                rows.append((c.name, how, None, None, int(c.grouped)))
                continue
            if how == "star":
                rows.append(("*", how, c.parents[0].reference, "*", 0))
                continue
            if how not in ("column", *AGGREGATES) or len(c.parents) != 1:
                continue
            at = c.parents[0]
            while at.made == "column" and len(at.parents) == 1:
                at = at.parents[0]
            if at.made == "table":
                rows.append((c.name, how, at.reference, at.name, int(c.grouped)))
            elif at.made == "count_star" and how == "column":
                rows.append((c.name, "count_star", None, None, int(at.grouped)))
        return rows

    return _table(files, MAPPED, of).where("column IS NOT NULL")


ASSERTION = ["kind", "path", "column", "value", "values", "target_path", "target_column"]
COMPARISONS = ("greater_than_or_equal", "greater_than", "less_than_or_equal", "less_than")


def infer(files: DataFrame, tests: DataFrame, dialect: str = "ansi") -> DataFrame:
    """Assertions that each text's own query implies, given those on its sources, with a reason.

    ``tests`` has (kind, path, column, value, values, target_path, target_column). Columns passed through keep all eight
    kinds, through inner joins too (also ``unique``, which a join that multiplies rows would break); columns of the right side of
    left joins keep none. AVG, MIN and MAX keep comparisons, and NOT NULL if there is a GROUP BY. COUNT(*) is not null and at least 0.
    """
    mapped = column_map(files, dialect).withColumnRenamed("path", "__path").withColumnRenamed("column", "__column")
    met = tests.join(mapped.where("how <> 'count_star'"), (F.col("path") == F.col("source")) & ((F.col("column") == F.col("source_column")) | (F.col("how") == "star")))
    kept = met.where(F.col("how").isin("column", "star") | F.col("kind").isin(*COMPARISONS) | ((F.col("kind") == "not_null") & (F.col("grouped") == 1)))
    passed = kept.select("kind", F.col("__path").alias("path"), F.when(F.col("how") == "star", F.col("column")).otherwise(F.col("__column")).alias("column"), "value", "values", "target_path", "target_column",
                         F.when(F.col("how").isin("column", "star"), "underlying_test").otherwise(F.concat(F.lit("underlying_test_with_operation:"), F.col("how"))).alias("reason"))
    kinds = {f.name: f.dataType for f in tests.schema.fields}
    counted = mapped.where("how = 'count_star'").select(F.explode(F.array(F.struct(F.lit("not_null").alias("kind"), F.lit(None).cast(kinds["value"]).alias("value")), F.struct(F.lit("greater_than_or_equal").alias("kind"), F.lit("0").cast(kinds["value"]).alias("value")))).alias("__t"), "__path", "__column")
    counted = counted.select("__t.kind", F.col("__path").alias("path"), F.col("__column").alias("column"), "__t.value", F.lit(None).cast(kinds["values"]).alias("values"), F.lit(None).cast(kinds["target_path"]).alias("target_path"), F.lit(None).cast(kinds["target_column"]).alias("target_column"), F.lit("count_star").alias("reason"))
    return passed.unionByName(counted).dropDuplicates(ASSERTION)


def skippable(files: DataFrame, tests: DataFrame, dialect: str = "ansi") -> DataFrame:
    """``tests`` with ``action`` (run or skip) and the reason: those that the model's own query implies needn't run."""
    inferred = infer(files, tests, dialect).select(*[F.col(c).alias(f"__{c}") for c in ASSERTION], "reason")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ASSERTION]
    return tests.join(inferred, same, "left").select(*ASSERTION, F.when(F.col("reason").isNull(), "run").otherwise("skip").alias("action"), "reason")


SAMPLE = {
    "orders_big": "WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100) SELECT o.o_orderkey AS id, c.c_name, o.o_totalprice * 2 AS twice FROM o JOIN customer c ON o.o_custkey = c.c_custkey",
    "per_customer": "SELECT o_custkey AS customer, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey",
    "both": "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region",
}
TESTS = [("not_null", "orders", "o_custkey", None, None, None, None), ("unique", "orders", "o_orderkey", None, None, None, None), ("not_null", "per_customer", "customer", None, None, None, None),
         ("greater_than", "orders", "o_totalprice", "0", None, None, None), ("greater_than", "per_customer", "top", "0", None, None, None), ("unique", "per_customer", "customer", None, None, None, None)]
TEST_SCHEMA = "kind string, path string, column string, value string, values array<string>, target_path string, target_column string"
