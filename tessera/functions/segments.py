"""Lists of nodes with the usual ways to walk them, and the three crawlers that drive rules over a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .parsing import Node, Tree

Test = Callable[[Node], bool]


def kinds_below(root: Node) -> dict[int, frozenset[str]]:
    """For each node (by identity) the kinds in it, its own included."""
    found: dict[int, frozenset[str]] = {}

    def visit(n: Node) -> frozenset[str]:
        out = {n.kind}
        for k in n.kids:
            out |= visit(k)
        found[id(n)] = frozenset(out)
        return found[id(n)]

    visit(root)
    return found


def path_to(root: Node, target: Node) -> list[Node]:
    """The nodes from ``root`` down to the parent of ``target``; empty if it isn't in there."""
    at, out = root, []
    while at is not target:
        down = next((k for k in at.kids if k is target or k.lo <= target.lo and target.hi <= k.hi and _holds(k, target)), None)
        if down is None:
            return []
        out.append(at)
        at = down
    return out


def _holds(n: Node, target: Node) -> bool:
    return n is target or any(_holds(k, target) for k in n.kids if k.lo <= target.lo and target.hi <= k.hi)


class Segments:
    """An immutable list of nodes of one tree."""

    def __init__(self, tree: Tree, nodes: list[Node] | None = None):
        self.tree, self.nodes = tree, [tree.root] if nodes is None else nodes

    def _of(self, nodes: list[Node]) -> Segments:
        return Segments(self.tree, nodes)

    def __iter__(self) -> Iterator[Node]:
        return iter(self.nodes)

    def __len__(self) -> int:
        return len(self.nodes)

    def __add__(self, other: Segments) -> Segments:
        return self._of(self.nodes + other.nodes)

    def raws(self) -> list[str]:
        return [self.tree.raw(n) for n in self.nodes]

    def first(self, test: Test = lambda n: True) -> Segments:
        return self._of([n for n in self.nodes if test(n)][:1])

    def last(self, test: Test = lambda n: True) -> Segments:
        return self._of([n for n in self.nodes if test(n)][-1:])

    def filter(self, test: Test) -> Segments:
        return self._of([n for n in self.nodes if test(n)])

    def map(self, of: Callable[[Node], Node]) -> Segments:
        return self._of([of(n) for n in self.nodes])

    def all(self, test: Test) -> bool:
        return all(map(test, self.nodes))

    def any(self, test: Test) -> bool:
        return any(map(test, self.nodes))

    def find(self, node: Node) -> int:
        """The place of a node in the list, or -1."""
        return next((i for i, n in enumerate(self.nodes) if n is node), -1)

    def children(self, *kinds: str) -> Segments:
        return self._of([k for n in self.nodes for k in n.kids if not kinds or k.kind in kinds])

    def crawl(self, *kinds: str, into: Test = lambda n: True) -> Segments:
        return self._of([x for n in self.nodes for x in n.walk(*kinds, into=into)])

    def select(self, test: Test = lambda n: True, while_: Test = lambda n: True, after: Node | None = None, before: Node | None = None) -> Segments:
        """Nodes that pass ``test``, behind ``after`` and in front of ``before``, up to the first that ``while_`` refuses."""
        lo = self.find(after) + 1 if after is not None else 0
        hi = self.find(before) if before is not None and self.find(before) >= 0 else len(self.nodes)
        out = []
        for n in self.nodes[lo:hi]:
            if not while_(n):
                break
            if test(n):
                out.append(n)
        return self._of(out)


def root_crawler(tree: Tree) -> Iterator[Node]:
    yield tree.root


def seeker(tree: Tree, *kinds: str, inside: bool = True) -> Iterator[Node]:
    """Nodes of ``kinds`` in order; subtrees without one of them aren't entered, nor, unless ``inside``, those that are found."""
    wanted, below = frozenset(kinds), kinds_below(tree.root)

    def visit(n: Node) -> Iterator[Node]:
        if not below[id(n)] & wanted:
            return
        if n.kind in wanted:
            yield n
            if not inside:
                return
        for k in n.kids:
            yield from visit(k)

    return visit(tree.root)


def token_crawler(tree: Tree) -> Iterator:
    yield from tree.tokens
