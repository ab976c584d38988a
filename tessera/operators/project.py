"""Linting of whole projects: each file with its own configuration and templater, as one pass over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dialects import lexicon
from ..functions import config as configuration
from ..functions.templating import Rendered, render
from . import lint

#: Rules that look at templated places too.
TARGETS_TEMPLATED = ("CV10", "JJ01", "LT12")
FOUND = "path string, code string, name string, line int, pos int, end_line int, end_pos int, description string, fixable int"
MODES = ("parallel", "sequential", "batch")


def _place(source: str, at: int) -> tuple[int, int]:
    before = source[:at]
    return before.count("\n") + 1, at - (before.rfind("\n") + 1) + 1


def settings(config: dict) -> dict:
    """What linting reads from a merged configuration; an unknown dialect, rule or templater is an error here."""
    core = config.get("core", {})
    codes = lint.selected(str(core.get("rules") or "core"), str(core.get("exclude_rules") or ""))
    dialect = core.get("dialect") or "ansi"
    lexicon(dialect)
    templater = core.get("templater") or "raw"
    own = config.get("templater", {}).get(templater, {})
    values = own.get("context", {k: v for k, v in own.items() if k not in ("param_style", "param_regex")})
    options = configuration.options(config, {n: c for c, n in lint.NAMES.items()}) | {k: v for k, v in core.items() if k in ("max_line_length",)}
    return {"rules": codes, "dialect": dialect, "templater": templater, "values": values, "style": own.get("param_style"), "regex": own.get("param_regex"), "options": options, "unused": bool(core.get("warn_unused_ignores"))}


def lint_source(source: str, s: dict) -> list[tuple]:
    """(code, name, line, pos, end line, end pos, description, fixable) of one file, by places in the source as it stands."""
    try:
        done: Rendered = render(source, s["templater"], s["values"], s["style"], s["regex"])
    except ValueError as e:
        return [("TMP", "templating", 1, 1, 1, 1, str(e), 0)]
    found = set()
    f = lint.File(done.text, s["dialect"], s["options"])
    for n in f.tree.root.walk("unparsable"):
        t = f.tree.first(n)
        found.add(("PRS", "parsing", *_span(source, done, t.start, t.start + len(f.tree.raw(n))), "Unparsable section", 0))
    masked, hidden = lint.suppressed(f), set()
    for code, t, why, edits in lint.checked(f, [c for c in s["rules"] if c != "JJ01"]):
        if s["templater"] != "raw" and code not in TARGETS_TEMPLATED and not _literal(done, t.start):
            continue
        if masked(code, t.line):
            hidden.add(t.line)
            continue
        found.add((code, lint.NAMES[code], *_span(source, done, t.start, t.start + len(t.raw)), why, int(bool(edits))))
    if "JJ01" in s["rules"]:  # padding is a matter of the source, not of what it renders to
        raw = lint.File(source, s["dialect"], s["options"])
        for code, t, why, edits in lint.checked(raw, ["JJ01"]):
            found.add((code, lint.NAMES[code], t.line, t.pos, *_place(source, t.start + len(t.raw)), why, int(bool(edits))))
    if s["unused"]:
        for t in lint.directives(f):
            if t.line not in hidden:
                found.add(("NOQA", "noqa", *_span(source, done, t.start, t.start + len(t.raw)), "Unused noqa", 0))
    return sorted(found, key=lambda x: (x[2], x[3], x[0], x[6]))


def _literal(done: Rendered, at: int) -> bool:
    return next((x.kind == "literal" for x in done.slices if x.start <= at < x.end), at >= len(done.text))


def _span(source: str, done: Rendered, a: int, b: int) -> tuple[int, int, int, int]:
    lo = done.source_of(a)
    return (*_place(source, lo), *_place(source, max(lo, done.source_of(b - 1) + 1 if b > a else lo)))


def violations(files: DataFrame, configs: dict[str, dict] | None = None, overrides: dict | None = None, mode: str = "parallel") -> DataFrame:
    """(path, code, name, line, pos, end_line, end_pos, description, fixable) of each file.

    ``configs`` has the parsed configuration of each folder that has one; a file's own lines come after these, and
    ``overrides`` last. In ``parallel`` files are dealt over all tasks, in ``sequential`` one task takes them in the order of
    their paths, and ``batch`` gives all files of a folder to one task, which reads their configuration once.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    configs = configs or {}
    settings(configuration.merge(configuration.DEFAULTS, *configs.values(), overrides or {}))  # errors come before the job
    rows = files.select("path", "source")
    if mode == "sequential":
        rows = rows.coalesce(1).sortWithinPartitions("path")
    elif mode == "batch":
        rows = rows.repartition(F.regexp_extract("path", "^(.*)/", 1)).sortWithinPartitions("path")
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [x.split() for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_folder: dict[str, dict] = {}
        for batch in batches:
            out = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, source = path.rpartition("/")[0], source or ""
                if folder not in by_folder:
                    by_folder[folder] = configuration.of_file(path, configs)
                try:
                    own = settings(configuration.merge(by_folder[folder], configuration.inline(source), overrides or {}))
                    out += [(path, *r) for r in lint_source(source, own)]
                except ValueError as e:  # a file's own lines name what there isn't
                    out.append((path, "CFG", "configuration", 1, 1, 1, 1, str(e), 0))
            cols = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    return rows.mapInArrow(run, FOUND)


def _source_edits(source: str, done: Rendered, group: list[tuple[int, int, str]]) -> list[tuple[int, int, str]] | None:
    """The edits of a group by places in the source; None if one of them touches a template or crosses its border."""
    out = []
    for a, b, new in group:
        if not done.slices:
            return group if not source else None
        home = next((s for s in done.slices if s.kind == "literal" and s.start <= a and b <= s.end and (a < s.end or a == b)), None)
        if home is None or sum(s.kind == "literal" and s.source_start == home.source_start for s in done.slices) > 1:
            return None  # a literal that comes out more than once would change in all places
        out.append((home.source_start + a - home.start, home.source_start + b - home.start, new))
    return out


def fix_source(source: str, s: dict, passes: int = 10) -> str:
    """The source after its rules' edits, templates left as they are; what can't be parsed, or is changed for the worse or
    back, stays."""
    if s["templater"] == "raw":
        return lint.fix_text(source, s["rules"], s["dialect"], s["options"], passes)

    def read(text: str) -> tuple[Rendered, lint.File] | None:
        try:
            done = render(text, s["templater"], s["values"], s["style"], s["regex"])
        except ValueError:
            return None
        f = lint.File(done.text, s["dialect"], s["options"])
        return None if list(f.tree.root.walk("unparsable")) else (done, f)

    for phase in ([r for r in s["rules"] if r not in lint.LAST and r != "JJ01"], [r for r in s["rules"] if r in lint.LAST]):
        seen = {source}
        for _ in range(passes):
            now = read(source)
            if now is None:
                return source
            done, f = now
            masked = lint.suppressed(f)
            groups = [g for code, t, _, edits in lint.checked(f, phase) if edits and not masked(code, t.line) and (g := _source_edits(source, done, edits)) is not None]
            new = lint.splice(source, groups)
            if new in seen or read(new) is None:
                break
            seen.add(new)
            source = new
    return source


def fixed(files: DataFrame, configs: dict[str, dict] | None = None, overrides: dict | None = None) -> DataFrame:
    """(path, source, changed): each file after its edits, under its own configuration and templater."""
    configs = configs or {}
    settings(configuration.merge(configuration.DEFAULTS, *configs.values(), overrides or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    new = fix_source(source or "", settings(configuration.merge(configuration.of_file(path, configs), configuration.inline(source or ""), overrides or {})))
                except ValueError:
                    new = source or ""
                out.append((path, new, int(new != (source or ""))))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32()), strict=True)], ["path", "source", "changed"])

    return files.select("path", "source").mapInArrow(run, "path string, source string, changed int")


# formatters: each makes of the violations what one kind of reader takes, as (path, text) rows


def human(found: DataFrame, colour: bool = False) -> DataFrame:
    """A heading and one line for each violation of a file."""
    head = lambda c: F.concat(F.lit("\033[1m"), c, F.lit("\033[0m")) if colour else c
    line = F.format_string("L:%4d | P:%4d | %4s | %s [%s]", "line", "pos", "code", "description", "name")
    each = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "pos", "code", line.alias("text")))).alias("__l"))
    return each.select("path", F.concat_ws("\n", F.concat(F.lit("== ["), head(F.col("path")), F.lit("] FAIL")), F.array_join(F.transform("__l", lambda x: x["text"]), "\n")).alias("text"))


def json(found: DataFrame) -> DataFrame:
    """Diagnostics of each file as editors take them, with lines and characters from 0."""
    place = lambda a, b: F.struct((F.col(a) - 1).alias("line"), (F.col(b) - 1).alias("character"))
    one = F.struct(F.struct(place("line", "pos").alias("start"), place("end_line", "end_pos").alias("end")).alias("range"), F.col("description").alias("message"), F.lit("Warning").alias("severity"), F.lit("tessera").alias("source"), "code")
    return found.groupBy("path").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("line", "pos", "code", one.alias("one")))), lambda x: x["one"])).alias("text"))


def annotations(found: DataFrame) -> DataFrame:
    return found.select("path", F.format_string("::error title=lint,file=%s,line=%d,col=%d::%s: %s [%s]", "path", "line", "pos", "code", "description", "name").alias("text"))


def nothing(found: DataFrame) -> DataFrame:
    return found.select("path", F.lit("").alias("text")).limit(0)


FORMATTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"human": human, "json": json, "github-annotation-native": annotations, "none": nothing}


def formatted(found: DataFrame, kind: str) -> DataFrame:
    if kind not in FORMATTERS:
        raise ValueError(f"unknown format: {kind}")
    return FORMATTERS[kind](found)


def completion(files: int, bad: int) -> str:
    return f"The linter processed {files} file(s); {bad} of them had violations." if bad else f"The linter processed {files} file(s). All finished."


def exit_code(found: DataFrame) -> int:
    """1 if there is any violation; the search ends at the first."""
    return int(bool(found.limit(1).count()))


def fix_exit_code(found: DataFrame) -> int:
    """1 if something is left that no edit mends."""
    return exit_code(found.where("fixable = 0"))
