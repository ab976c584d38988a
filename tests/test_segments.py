"""Walking trees: lists of nodes, paths, kinds below, crawlers."""

from tessera.functions.parsing import Tree
from tessera.functions.segments import Segments, kinds_below, path_to, root_crawler, seeker, token_crawler

SQL = "SELECT a.x, (SELECT max(b.y) FROM u AS b) AS m FROM t AS a JOIN v ON a.k = v.k WHERE a.z > 1"


def test_lists():
    tree = Tree(SQL)
    refs = Segments(tree).crawl("column_ref")
    assert refs.raws() == ["a.x", "b.y", "a.k", "v.k", "a.z"]
    assert Segments(tree).crawl("column_ref", into=lambda n: n.kind not in ("subquery", "bracketed")).raws() == ["a.x", "a.k", "v.k", "a.z"]
    ours = lambda n: tree.raw(n).startswith("a.")
    assert refs.filter(ours).raws() == ["a.x", "a.k", "a.z"] and refs.first(lambda n: not ours(n)).raws() == ["b.y"] and refs.last().raws() == ["a.z"]
    assert refs.any(ours) and not refs.all(ours) and len(refs + refs) == 10 and refs.find(refs.nodes[2]) == 2 and refs.find(tree.root) == -1
    assert refs.select(ours, after=refs.nodes[0], before=refs.nodes[4]).raws() == ["a.k"]
    assert refs.select(while_=ours).raws() == ["a.x"]
    assert Segments(tree).children("statement").children().nodes[0].kind == "query"
    assert refs.map(lambda n: tree.root).all(lambda n: n is tree.root)


def test_paths_and_kinds():
    tree = Tree(SQL)
    for n in tree.root.walk():
        above = path_to(tree.root, n)
        assert n is tree.root or above[0] is tree.root and any(k is n for k in above[-1].kids)
    below = kinds_below(tree.root)
    assert {"join", "column_ref", "file"} <= below[id(tree.root)]
    assert path_to(tree.root, Tree("SELECT 1").root) == []


def test_crawlers():
    tree = Tree(SQL)
    assert list(root_crawler(tree)) == [tree.root]
    assert [n.kind for n in seeker(tree, "select")] == ["select", "select"] and len(list(seeker(tree, "select", inside=False))) == 1
    assert not list(seeker(tree, "values"))
    assert "".join(t.raw for t in token_crawler(tree)) == SQL
