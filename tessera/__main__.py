"""Command line: ``python -m tessera lint|fix|parse PATH`` (``-`` reads standard input)."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .functions import config as configuration
from .operators import analysis, project
from .sources import sql_files

CONFIG = ".tessera"
IGNORE = ".tesseraignore"


def folders(path: str) -> dict[str, dict]:
    """The configurations of the folders from the root down to ``path`` and below it."""
    top = Path(path).resolve()
    names = [p / CONFIG for p in (top, *top.parents) if (p / CONFIG).is_file()] + (list(top.rglob(CONFIG)) if top.is_dir() else [])
    return {f"file:{at}": parsed for n in dict.fromkeys(names) for parsed in [configuration.parse(n.read_text())] for at in [n.parent]}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=["lint", "fix", "parse"])
    p.add_argument("path")
    p.add_argument("--dialect")
    p.add_argument("--rules")
    p.add_argument("--exclude-rules")
    p.add_argument("--templater")
    p.add_argument("--format", default="human", choices=sorted(project.FORMATTERS))
    p.add_argument("--mode", default="parallel", choices=project.MODES)
    a = p.parse_args(args)
    overrides = {"core": {k: v for k, v in (("dialect", a.dialect), ("rules", a.rules), ("exclude_rules", a.exclude_rules), ("templater", a.templater)) if v}}
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if a.path == "-":
        files, configs = sql_files.standard_input(spark), {}
    else:
        skip = Path(a.path) / IGNORE
        files, configs = sql_files.read(spark, a.path, ignore_file=skip.read_text() if skip.is_file() else None), folders(a.path)
    files = files.withColumn("path", files["path"]).cache()
    try:
        # paths as Spark names them: file:///a/b
        configs = {k.replace("file:", "file://"): v for k, v in configs.items()}
        if a.command == "parse":
            for r in analysis.trees(files, a.dialect or "ansi").orderBy("path", "node").toLocalIterator():
                print(f"{'  ' * r['depth']}{r['kind']}{'' if r['raw'] is None else ': ' + repr(r['raw'])}")
            return 0
        found = project.violations(files, configs, overrides, a.mode)
        if a.command == "fix":
            left = project.fix_exit_code(found)
            done = project.fixed(files, configs, overrides).cache()
            if a.path == "-":
                print("".join(r["source"] for r in done.collect()), end="")
            else:
                print(f"{sql_files.write_back(spark, done)} file(s) fixed.", file=sys.stderr)
            return left
        out = sys.stderr if a.format == "human" else sys.stdout
        for r in project.formatted(found, a.format).orderBy("path").toLocalIterator():
            print(r["text"], file=out)
        if a.format == "human":
            print(project.completion(files.count(), found.select("path").distinct().count()), file=sys.stderr)
        return project.exit_code(found)
    finally:
        files.unpersist()


if __name__ == "__main__":
    sys.exit(main())
