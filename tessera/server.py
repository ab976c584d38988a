"""An editor's server: JSON messages with a Content-Length header over two streams; documents are linted as they change.

One process serves one editor and needs no cluster: it calls the same functions of one text as the jobs do for many.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import BinaryIO

from .functions import config as configuration
from .functions.lexing import lex
from .operators import lint, project
from .operators.editor import CLASSES

#: The kinds of tokens, in the order of their numbers in messages.
LEGEND = ("keyword", "variable", "string", "number", "comment", "operator")


def messages(stream: BinaryIO) -> Iterator[dict]:
    while True:
        length = None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        if length is None:
            return
        yield json.loads(stream.read(length))


def framed(message: dict) -> bytes:
    body = json.dumps(message).encode()
    return b"Content-Length: %d\r\n\r\n" % len(body) + body


def _units(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


class Server:
    def __init__(self, config: dict | None = None):
        self.config = configuration.merge(configuration.DEFAULTS, config or {})
        self.open: dict[str, tuple[str, int | None]] = {}
        self.stopped = False

    def settings(self, text: str) -> dict:
        return project.settings(configuration.merge(self.config, configuration.inline(text)))

    def diagnostics(self, uri: str) -> dict:
        text, version = self.open[uri]
        lines = text.split("\n")
        place = lambda line, pos: {"line": line - 1, "character": _units(lines[line - 1][: pos - 1]) if line <= len(lines) else 0}
        try:
            found = project.lint_source(text, self.settings(text))
        except ValueError as e:
            found = [("CFG", "configuration", 1, 1, 1, 1, str(e), 0)]
        rows = [{"range": {"start": place(a, b), "end": place(c, d)}, "message": why, "severity": 2, "source": "tessera", "code": code} for code, _, a, b, c, d, why, _ in found]
        return {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": uri, "version": version, "diagnostics": rows}}

    def formatted(self, uri: str) -> list[dict]:
        text, _ = self.open[uri]
        s = self.settings(text)
        new = lint.fix_text(text, s["rules"], s["dialect"], s["options"]) if s["templater"] == "raw" else text
        if new == text:
            return []
        lines = text.split("\n")
        return [{"range": {"start": {"line": 0, "character": 0}, "end": {"line": len(lines) - 1, "character": _units(lines[-1])}}, "newText": new}]

    def tokens(self, uri: str) -> list[int]:
        """Five numbers a token: lines and units from the one before, length, kind, and no modifiers."""
        out, line, left = [], 0, 0
        text, _ = self.open[uri]
        lines = text.split("\n")
        for t in lex(text, self.settings(text)["dialect"]):
            if t.kind not in CLASSES:
                continue
            for k, part in enumerate(t.raw.split("\n")):
                if not part:
                    continue
                at = t.line - 1 + k
                col = _units(lines[at][: t.pos - 1]) if k == 0 else 0
                out += [at - line, col - left if at == line else col, _units(part), LEGEND.index(CLASSES[t.kind]), 0]
                line, left = at, col
        return out

    def handle(self, message: dict) -> list[dict]:
        """The messages that answer one."""
        method, params, number = message.get("method"), message.get("params") or {}, message.get("id")
        answer = lambda result: [{"jsonrpc": "2.0", "id": number, "result": result}]
        uri = params.get("textDocument", {}).get("uri")
        if method == "initialize":
            return answer({"capabilities": {"textDocumentSync": {"openClose": True, "change": 1, "save": True}, "documentFormattingProvider": True, "semanticTokensProvider": {"legend": {"tokenTypes": list(LEGEND), "tokenModifiers": []}, "full": True}}, "serverInfo": {"name": "tessera"}})
        if method == "shutdown":
            return answer(None)
        if method == "exit":
            self.stopped = True
            return []
        if method == "textDocument/didOpen":
            self.open[uri] = params["textDocument"]["text"], params["textDocument"].get("version")
            return [self.diagnostics(uri)]
        if method == "textDocument/didChange":  # whole texts; of several changes the last holds
            self.open[uri] = params["contentChanges"][-1]["text"], params["textDocument"].get("version")
            return [self.diagnostics(uri)]
        if method == "textDocument/didSave" and uri in self.open:
            return [self.diagnostics(uri)]
        if method == "textDocument/didClose":
            self.open.pop(uri, None)
            return [{"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": uri, "diagnostics": []}}]
        if method == "workspace/didChangeConfiguration":
            self.config = configuration.merge(configuration.DEFAULTS, (params.get("settings") or {}).get("tessera") or {})
            return [self.diagnostics(u) for u in self.open]
        if method in ("textDocument/formatting", "textDocument/semanticTokens/full"):
            if uri not in self.open:
                return [{"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": f"not open: {uri}"}}]
            return answer(self.formatted(uri) if method.endswith("formatting") else {"data": self.tokens(uri)})
        if number is not None:
            return [{"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method: {method}"}}]
        return []


def serve(given: BinaryIO | None = None, out: BinaryIO | None = None, config: dict | None = None) -> None:
    given, out, server = given or sys.stdin.buffer, out or sys.stdout.buffer, Server(config)
    for message in messages(given):
        try:
            answers = server.handle(message)
        except Exception as e:  # noqa: BLE001
            answers = [{"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32603, "message": f"{type(e).__name__}: {e}"}}] if message.get("id") is not None else []
        for a in answers:
            out.write(framed(a))
        out.flush()
        if server.stopped:
            return


if __name__ == "__main__":
    serve()
