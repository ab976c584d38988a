"""Configuration files in INI form: nested sections, merged from the root of a project down to a file's folder."""

from __future__ import annotations

#: Defaults that the operators read.
DEFAULTS: dict = {"core": {"dialect": None, "templater": "raw", "rules": "core", "exclude_rules": None, "runaway_limit": 10, "sql_file_exts": ".sql,.sql.j2,.dml,.ddl", "warn_unused_ignores": False, "max_line_length": 80}}


def value(text: str):
    """Whole numbers, other numbers, booleans and none by their looks; else the text."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low == "none":
        return None
    for kind in (int, float):
        try:
            return kind(low)
        except ValueError:
            pass
    return text.strip()


def parse(text: str, tool: str = "tessera") -> dict:
    """``[tool]`` holds the core section, ``[tool:a:b]`` nests; keys may be given below a section in any order."""
    out: dict = {}
    at: dict | None = None
    last = None
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare[0] in "#;":
            continue
        if bare.startswith("[") and bare.endswith("]"):
            names = bare[1:-1].split(":")
            at = None
            if names[0] == tool:
                at = out
                for n in names[1:] or ["core"]:
                    at = at.setdefault(n, {})
            last = None
        elif at is not None and line[0].isspace() and last is not None:
            at[last] = f"{at[last] or ''}\n{bare}".strip()
        elif at is not None and "=" in bare:
            last, _, text_ = (x.strip() for x in bare.partition("="))
            at[last] = value(text_)
    return out


def merge(*configs: dict) -> dict:
    """Later ones win; sections are merged key by key."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else merge(v) if isinstance(v, dict) else v
    return out


def of_file(path: str, configs: dict[str, dict]) -> dict:
    """The configuration of a file; ``configs`` has that of each folder that has one."""
    parts = path.split("/")[:-1]
    folders = ["/".join(parts[:k]) or "/" for k in range(1, len(parts) + 1)] or ["."]
    return merge(DEFAULTS, *(configs[f] for f in folders if f in configs))


def inline(source: str, tool: str = "tessera") -> dict:
    """Lines ``-- tool:section:key:value`` of a text."""
    out: dict = {}
    for line in source.splitlines():
        bare = line.strip().removeprefix("--").strip()
        if line.lstrip().startswith("--") and bare.startswith(f"{tool}:"):
            *names, text = bare.split(":")[1:]
            if names:
                at = out
                for n in names[:-1] or ["core"]:
                    at = at.setdefault(n, {})
                at[names[-1]] = value(text)
    return out


def options(config: dict, names: dict[str, str] | None = None) -> dict:
    """Rule options as the lint operators take them: ``CODE.option``; ``names`` gives the code of a section's name."""
    out = {}
    for section, held in config.get("rules", {}).items():
        if isinstance(held, dict):
            out |= {f"{(names or {}).get(section, section)}.{k}": v for k, v in held.items()}
        else:
            out[section] = held
    return out
