"""A subset of Jinja with slices: expressions with filters and tests, set, if, for, macro, comments, raw, white-space control.

Expressions are read by Python's own grammar and evaluated node by node, so a template reaches only the values it is given.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable

TAG = re.compile(r"\{\{-?(?P<expr>.*?)-?\}\}|\{%-?\+?(?P<stmt>.*?)-?%\}|\{#-?.*?-?#\}", re.S)


class TemplateError(ValueError):
    pass


class Undefined:
    """What a name without a value gives: it prints as nothing, has no items, and is remembered by its name."""

    def __init__(self, name: str):
        self.name = name

    def __str__(self) -> str:
        return ""

    def __iter__(self):
        return iter(())

    def __bool__(self) -> bool:
        return False

    def __len__(self) -> int:
        return 0


def _default(x, value="", even_empty=False):
    return value if isinstance(x, Undefined) or even_empty and not x else x


FILTERS: dict[str, Callable] = {
    "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "trim": lambda x: str(x).strip(), "title": lambda x: str(x).title(), "capitalize": lambda x: str(x).capitalize(),
    "join": lambda x, sep="": sep.join(map(str, x)), "length": len, "count": len, "default": _default, "d": _default, "replace": lambda x, a, b: str(x).replace(a, b),
    "first": lambda x: next(iter(x), Undefined("first")), "last": lambda x: list(x)[-1] if len(x) else Undefined("last"), "list": list, "sort": sorted, "unique": lambda x: list(dict.fromkeys(x)), "reverse": lambda x: list(reversed(list(x))),
    "int": lambda x, d=0: int(x) if str(x).lstrip("+-").isdigit() else d, "float": float, "string": str, "abs": abs, "round": round, "sum": sum, "min": min, "max": max, "safe": lambda x: x,
    "items": lambda x: list(x.items()), "map": lambda x, attribute=None: [i[attribute] if isinstance(i, dict) else getattr(i, attribute) for i in x], "tojson": lambda x: __import__("json").dumps(x),
}
TESTS: dict[str, Callable] = {
    "defined": lambda x: not isinstance(x, Undefined), "undefined": lambda x: isinstance(x, Undefined), "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "number": lambda x: isinstance(x, (int, float)),
    "mapping": lambda x: isinstance(x, dict), "iterable": lambda x: hasattr(x, "__iter__"), "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0, "true": lambda x: x is True, "false": lambda x: x is False,
}
BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
#: Methods of plain values that an expression may call.
METHODS = frozenset("append extend items keys values get upper lower strip split join replace startswith endswith format title count index pop update".split())
#: A template may take so many steps.
STEPS = 200_000


class Scope:
    def __init__(self, values: dict):
        self.levels, self.missing, self.steps = [dict(values)], set(), 0

    def get(self, name: str):
        for level in reversed(self.levels):
            if name in level:
                return level[name]
        self.missing.add(name)
        return Undefined(name)


def _prepared(text: str) -> str:
    """The words of the template language as Python has them."""
    text = re.sub(r"\bis\s+not\s+(\w+)(?!\w)", r" is not _test_\1", text.strip())
    text = re.sub(r"\bis\s+(?!not\b)(\w+)(?!\w)", r" is _test_\1", text)
    for a, b in (("true", "True"), ("false", "False"), ("none", "None")):
        text = re.sub(rf"(?<![\w.'\"]){a}(?![\w'\"])", b, text)
    return re.sub(r"~", "@", text)


def evaluate(text: str, scope: Scope):
    try:
        tree = ast.parse(_prepared(text), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(f"can't read the expression {text.strip()!r}") from e
    return _value(tree, scope)


def _value(n: ast.AST, s: Scope):
    s.steps += 1
    if s.steps > STEPS:
        raise TemplateError("the template takes too many steps")
    if isinstance(n, ast.Constant):
        return n.value
    if isinstance(n, ast.Name):
        return s.get(n.id)
    if isinstance(n, (ast.List, ast.Tuple)):
        return [_value(x, s) for x in n.elts]
    if isinstance(n, ast.Dict):
        return {_value(k, s): _value(v, s) for k, v in zip(n.keys, n.values, strict=True)}
    if isinstance(n, ast.BoolOp):
        for x in n.values:
            got = _value(x, s)
            if bool(got) != isinstance(n.op, ast.And):
                return got
        return got
    if isinstance(n, ast.UnaryOp):
        got = _value(n.operand, s)
        return not got if isinstance(n.op, ast.Not) else -got
    if isinstance(n, ast.IfExp):
        return _value(n.body if _value(n.test, s) else n.orelse, s)
    if isinstance(n, ast.BinOp):
        if isinstance(n.op, ast.BitOr):  # a filter
            name = n.right.func.id if isinstance(n.right, ast.Call) and isinstance(n.right.func, ast.Name) else getattr(n.right, "id", None)
            if name not in FILTERS:
                raise TemplateError(f"unknown filter: {name}")
            args, kwargs = ([_value(a, s) for a in n.right.args], {k.arg: _value(k.value, s) for k in n.right.keywords}) if isinstance(n.right, ast.Call) else ([], {})
            return FILTERS[name](_value(n.left, s), *args, **kwargs)
        if isinstance(n.op, ast.MatMult):
            return f"{_value(n.left, s)}{_value(n.right, s)}"
        return BINARY[type(n.op)](_value(n.left, s), _value(n.right, s))
    if isinstance(n, ast.Compare):
        left = _value(n.left, s)
        for op, right in zip(n.ops, n.comparators, strict=True):
            if isinstance(op, (ast.Is, ast.IsNot)):
                name = getattr(right, "id", "").removeprefix("_test_")
                if name not in TESTS and not isinstance(right, ast.Constant):
                    raise TemplateError(f"unknown test: {name}")
                ok = TESTS[name](left) if name in TESTS else left is right.value
                ok = ok if isinstance(op, ast.Is) else not ok
            else:
                got = _value(right, s)
                ok = COMPARE[type(op)](left, got)
                left = got
            if not ok:
                return False
        return True
    if isinstance(n, ast.Attribute):
        of = _value(n.value, s)
        if isinstance(of, dict) and n.attr in of:
            return of[n.attr]
        if isinstance(of, Undefined):
            raise TemplateError(f"{of.name} is undefined")
        if n.attr in METHODS and isinstance(of, (str, list, dict)):
            return getattr(of, n.attr)
        return Undefined(n.attr)
    if isinstance(n, ast.Subscript):
        of, at = _value(n.value, s), n.slice
        at = slice(*(None if x is None else _value(x, s) for x in (at.lower, at.upper, at.step))) if isinstance(at, ast.Slice) else _value(at, s)
        try:
            return of[at]
        except (KeyError, IndexError, TypeError):
            return Undefined(str(at))
    if isinstance(n, ast.Call):
        f = _value(n.func, s)
        if not callable(f):
            raise TemplateError(f"{getattr(f, 'name', f)} is undefined or no function")
        return f(*[_value(a, s) for a in n.args], **{k.arg: _value(k.value, s) for k in n.keywords})
    raise TemplateError(f"not allowed in a template: {type(n).__name__}")


def _tokens(source: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, inside) of the texts and tags, with the white space taken off that a dash takes."""
    out, at, strip = [], 0, False

    def text(a: int, b: int, before_dash: bool) -> None:
        lo, hi = a, b
        if strip:
            lo += len(source[lo:hi]) - len(source[lo:hi].lstrip())
        if before_dash:
            hi -= len(source[lo:hi]) - len(source[lo:hi].rstrip())
        for kind, x, y in (("gone", a, lo), ("text", lo, hi), ("gone", hi, b)):
            if x < y:
                out.append((kind, x, y, ""))

    raw = None
    for m in TAG.finditer(source):
        word = (m["stmt"] or "").strip()
        if raw is not None and word != "endraw":
            continue
        text(at if raw is None else raw, m.start(), source[m.start() + 2] == "-")
        strip = source[m.end() - 3] == "-"
        kind = "expr" if m["expr"] is not None else "stmt" if m["stmt"] is not None else "comment"
        if word in ("raw", "endraw"):
            raw = m.end() if word == "raw" else None
            kind = "comment"
        out.append((kind, m.start(), m.end(), (m["expr"] or m["stmt"] or "").strip()))
        at = m.end()
    text(at, len(source), False)
    return out


def render(source: str, values: dict) -> tuple[list[tuple[str, int, int, str]], set[str]]:
    """((kind, start, end, text) of the pieces in the order they come out, names without a value)."""
    tokens, scope = _tokens(source), Scope(values)
    out: list[tuple[str, int, int, str]] = []

    def block(i: int, *ends: str) -> int:
        """The place of the tag that ends the block that begins at ``i``."""
        depth = 0
        while i < len(tokens):
            word = tokens[i][3].split(None, 1)[0] if tokens[i][0] == "stmt" and tokens[i][3] else ""
            if depth == 0 and word in ends:
                return i
            if word in ("if", "for", "macro", "call", "filter") or word == "set" and "=" not in tokens[i][3]:
                depth += 1
            elif word.startswith("end"):
                depth -= 1
            i += 1
        raise TemplateError(f"no {' or '.join(ends)}")

    def run(i: int, end: int) -> None:
        while i < end:
            kind, a, b, inside = tokens[i]
            if kind == "text":
                out.append(("literal", a, b, source[a:b]))
            elif kind in ("comment", "gone"):
                out.append(("comment" if kind == "comment" else "templated", a, b, ""))
            elif kind == "expr":
                got = evaluate(inside, scope)
                out.append(("templated", a, b, "" if got is None else str(got).lower() if isinstance(got, bool) else str(got)))
            else:
                i = statement(i, end)
                continue
            i += 1

    def captured(i: int, end: int) -> str:
        nonlocal out
        before, out = out, []
        try:
            run(i, end)
            return "".join(x[3] for x in out)
        finally:
            out = before

    def statement(i: int, end: int) -> int:
        _, a, b, inside = tokens[i]
        word, _, rest = inside.partition(" ")
        out.append(("block", a, b, ""))
        if word == "set":
            name, eq, value = rest.partition("=")
            if eq:
                names = [x.strip() for x in name.split(",")]
                got = evaluate(value, scope)
                for n, v in zip(names, got if len(names) > 1 else [got], strict=True):
                    scope.levels[-1][n] = v
                return i + 1
            stop = block(i + 1, "endset")
            scope.levels[-1][rest.strip()] = captured(i + 1, stop)
            return stop + 1
        if word == "if":
            at, done = i, False
            test = rest
            while True:
                stop = block(at + 1, "elif", "else", "endif")
                if not done and (test is None or evaluate(test, scope)):
                    run(at + 1, stop)
                    done = True
                out.append(("block", tokens[stop][1], tokens[stop][2], ""))
                ended, _, test = tokens[stop][3].partition(" ")
                if ended == "endif":
                    return stop + 1
                test = test if ended == "elif" else None
                at = stop
        if word == "for":
            m = re.match(r"(.+?)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"can't read: {inside}")
            stop = block(i + 1, "else", "endfor")
            names, items = [x.strip() for x in m[1].split(",")], list(evaluate(m[2], scope))
            for k, item in enumerate(items):
                loop = {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(items) - 1, "length": len(items), "revindex": len(items) - k}
                scope.levels.append(dict(zip(names, item if len(names) > 1 else [item], strict=True)) | {"loop": loop})
                run(i + 1, stop)
                scope.levels.pop()
            if tokens[stop][3] == "else":
                last = block(stop + 1, "endfor")
                if not items:
                    run(stop + 1, last)
                stop = last
            out.append(("block", tokens[stop][1], tokens[stop][2], ""))
            return stop + 1
        if word == "macro":
            m = re.match(r"(\w+)\s*\((.*)\)$", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"can't read: {inside}")
            stop = block(i + 1, "endmacro")
            given = ast.parse(f"f({_prepared(m[2])})", mode="eval").body
            names = [x.id for x in given.args] + [k.arg for k in given.keywords]
            defaults = {k.arg: k.value for k in given.keywords}

            def call(*args, **kwargs):
                level = {n: _value(d, scope) for n, d in defaults.items()} | dict(zip(names, args, strict=False)) | kwargs
                if len(scope.levels) > 50:
                    raise TemplateError("macros call each other too deeply")
                scope.levels.append(level)
                try:
                    return captured(i + 1, stop)
                finally:
                    scope.levels.pop()

            scope.levels[-1][m[1]] = call
            return stop + 1
        if word in ("do",):
            evaluate(rest, scope)
            return i + 1
        raise TemplateError(f"unknown statement: {word}")

    try:
        run(0, len(tokens))
    except (TypeError, ValueError, KeyError, AttributeError, ZeroDivisionError, RecursionError) as e:
        raise e if isinstance(e, TemplateError) else TemplateError(f"{type(e).__name__}: {e}") from e
    return out, scope.missing


def model_values(values: dict) -> dict:
    """What models of a project may call beside their own values: references give names, configuration gives nothing."""
    own = values.get("vars", {})
    return {
        "ref": lambda *names: values.get("refs", {}).get(names[-1], names[-1]), "source": lambda a, b: f"{a}.{b}", "config": lambda *a, **k: "", "var": lambda name, default=None: own.get(name, default),
        "env_var": lambda name, default="": default, "is_incremental": lambda: bool(values.get("incremental", False)), "this": values.get("this", "this_model"), "target": values.get("target", {"name": "dev", "schema": "public"}), "run_started_at": "", "execute": True,
    } | values
