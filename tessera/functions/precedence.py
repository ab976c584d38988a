"""Precedence: the flat children of an expression grouped into a tree of operators, as SQL binds them."""

from __future__ import annotations

from .parsing import Node, Tree

#: From the loosest to the tightest; operators of one level group from the left.
LEVELS: tuple[frozenset[str], ...] = tuple(frozenset(x.split()) for x in (
    "or", "xor", "and", "not", "= <> != < > <= >= <=> is in like ilike rlike regexp between similar glob overlaps isnull notnull", "|", "^ #", "&", "<< >>", "||", "+ -", "* / % div mod", "unary", "collate at", ":: [",
))
_LEVEL = {w: i for i, words in enumerate(LEVELS) for w in words}
UNARY = _LEVEL["unary"]
COMPARISON = _LEVEL["="]


class Operator(tuple):
    """(name, operands...)."""

    __slots__ = ()

    def __new__(cls, name: str, *operands):
        return super().__new__(cls, (name, *operands))


class _Items:
    def __init__(self, tree: Tree, node: Node):
        self.tree, self.items, self.at = tree, [], 0
        i = node.lo
        for k in [*node.kids, None]:
            stop = node.hi if k is None else k.lo
            while i < stop:
                self.items.append(tree.low[i])
                i += 1
            if k is not None:
                self.items.append(k)
                i = k.hi
        # two signs that make one operator
        joined: list = []
        for x in self.items:
            if isinstance(x, str) and joined and (joined[-1], x) in (("<", "<"), (">", ">"), ("-", ">"), ("|", "|")):
                joined[-1] += x
            else:
                joined.append(x)
        self.items = joined

    def peek(self, k: int = 0):
        return self.items[self.at + k] if self.at + k < len(self.items) else None

    def take(self, *words: str) -> bool:
        if isinstance(self.peek(), str) and self.peek() in words:
            self.at += 1
            return True
        return False


def grouped(tree: Tree, node: Node):
    """``Operator`` tuples with nodes as leaves; an expression that is one value is that value."""
    items = _Items(tree, node)
    got = _read(items, 0)
    if items.peek() is not None:
        raise ValueError(f"can't group {tree.raw(node)!r}")
    return got


def _read(x: _Items, least: int):
    left = _first(x)
    while True:
        word = x.peek()
        negated = word == "not" and x.peek(1) in ("in", "like", "ilike", "rlike", "regexp", "between", "similar", "glob")
        name = x.peek(1) if negated else word
        if isinstance(name, Node) and name.kind in ("subscript", "data_type"):
            x.at += 1
            left = Operator("[" if name.kind == "subscript" else "::", left, name)
            continue
        level = _LEVEL.get(name) if isinstance(name, str) else None
        if level is None or level < least or name in ("not", "unary"):
            return left
        x.at += 1 + negated
        if name == "::":
            left = Operator("::", left, x.peek())
            x.at += 1
        elif name == "between":
            x.take("symmetric", "asymmetric")
            low = _read(x, COMPARISON + 1)
            if not x.take("and"):
                raise ValueError("BETWEEN without AND")
            left = Operator("between", left, low, _read(x, COMPARISON + 1))
        elif name == "is":
            negated = x.take("not")
            if x.take("distinct"):
                if not x.take("from"):
                    raise ValueError("DISTINCT without FROM")
                left = Operator("is distinct from", left, _read(x, COMPARISON + 1))
            else:
                left = Operator("is", left, _first(x))
        elif name in ("isnull", "notnull"):
            left = Operator(name, left)
        elif name == "at":
            x.take("time")
            x.take("zone")
            left = Operator("at time zone", left, _read(x, level + 1))
        else:
            right = _read(x, level + 1)
            left = Operator(name, left, right, _read(x, COMPARISON + 1)) if name in ("like", "ilike", "similar") and x.take("escape") else Operator(name, left, right)
        if negated:
            left = Operator("not", left)


def _first(x: _Items):
    word = x.peek()
    if word is None:
        raise ValueError("an operand is missing")
    x.at += 1
    if isinstance(word, Node):
        return word
    if word == "not":
        return Operator("not", _read(x, _LEVEL["not"]))
    if word in ("-", "+", "~"):
        return Operator(word, _read(x, UNARY))
    if word in ("exists", "interval", "any", "all", "distinct", "prior"):
        return Operator(word, _read(x, UNARY))
    raise ValueError(f"{word!r} is no operand")


def written(tree: Tree, found) -> str:
    """The grouped expression with a bracket around every operator."""
    if isinstance(found, Operator):
        name, *rest = found
        parts = [written(tree, k) for k in rest]
        return f"({name} {parts[0]})" if len(parts) == 1 else f"({f' {name} '.join(parts)})"
    inner = found.kids[0] if found.kind == "bracketed" and len(found.kids) == 1 and found.kids[0].kind == "expression" else None
    return written(tree, grouped(tree, inner)) if inner is not None else tree.raw(found)
