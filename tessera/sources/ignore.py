"""Ignore files: patterns as version control has them, compiled to one test of a path below the root."""

from __future__ import annotations

import re


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + (2 if pattern.startswith("**", i) else 1)
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Ignore:
    """The last pattern that matches a path decides; ``!`` takes back, but not below a folder that is ignored."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            line = line[1:] if back else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = _regex(line.lstrip("/"))
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.S), back, folder))

    def _decides(self, path: str, is_folder: bool) -> bool:
        out = False
        for pattern, back, folder in self.rules:
            if (is_folder or not folder) and pattern.match(path):
                out = not back
        return out

    def __call__(self, path: str) -> bool:
        """Whether a file, named by its path below the root, is ignored."""
        parts = path.strip("/").split("/")
        return any(self._decides("/".join(parts[:k]), True) for k in range(1, len(parts))) or self._decides("/".join(parts), False)
