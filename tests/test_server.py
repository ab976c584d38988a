"""The editor's server and the tools of one text."""

import io

import pytest

from tessera import server, tools


def talk(*sent, config=None):
    out = io.BytesIO()
    server.serve(io.BytesIO(b"".join(map(server.framed, sent))), out, config)
    out.seek(0)
    return list(server.messages(out))


def note(method, **params):
    return {"jsonrpc": "2.0", "method": method, "params": params}


def opened(text, uri="file:///a.sql"):
    return note("textDocument/didOpen", textDocument={"uri": uri, "text": text, "version": 1})


CV04 = {"core": {"rules": "CV04"}}


def test_documents_are_linted_as_they_change():
    got = talk(
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, note("initialized"), opened("SELECT '😀', count(1)\n"),
        note("textDocument/didChange", textDocument={"uri": "file:///a.sql", "version": 2}, contentChanges=[{"text": "x"}, {"text": "SELECT count(*)\n"}]), note("textDocument/didSave", textDocument={"uri": "file:///a.sql"}),
        note("textDocument/didClose", textDocument={"uri": "file:///a.sql"}), {"jsonrpc": "2.0", "id": 2, "method": "shutdown"}, note("exit"), opened("never read"), config=CV04,
    )
    assert got[0]["result"]["capabilities"]["textDocumentSync"]["change"] == 1
    first = got[1]["params"]["diagnostics"]
    assert [(d["code"], d["range"]["start"], d["range"]["end"]) for d in first] == [("CV04", {"line": 0, "character": 13}, {"line": 0, "character": 18})]
    assert [m["params"]["diagnostics"] for m in got[2:5]] == [[], [], []] and got[2]["params"]["version"] == 2
    assert got[5] == {"jsonrpc": "2.0", "id": 2, "result": None} and len(got) == 6


def test_formatting_tokens_and_errors():
    uri = {"uri": "file:///a.sql"}
    got = talk(
        opened("SELECT count(1), 'é😀' -- n"), {"jsonrpc": "2.0", "id": 1, "method": "textDocument/formatting", "params": {"textDocument": uri}}, {"jsonrpc": "2.0", "id": 2, "method": "textDocument/semanticTokens/full", "params": {"textDocument": uri}},
        {"jsonrpc": "2.0", "id": 3, "method": "textDocument/formatting", "params": {"textDocument": {"uri": "file:///b.sql"}}}, {"jsonrpc": "2.0", "id": 4, "method": "no/such"}, note("workspace/didChangeConfiguration", settings={"tessera": {"core": {"rules": "LT12"}}}), config=CV04,
    )
    assert got[1]["result"][0]["newText"] == "SELECT count(*), 'é😀' -- n"
    assert got[2]["result"]["data"] == [0, 0, 6, 0, 0, 0, 7, 5, 1, 0, 0, 6, 1, 3, 0, 0, 4, 5, 2, 0, 0, 6, 4, 4, 0]
    assert got[3]["error"]["code"] == -32602 and got[4]["error"]["code"] == -32601
    assert [d["code"] for d in got[5]["params"]["diagnostics"]] == ["LT12"]
    assert [d["code"] for d in talk(opened("-- tessera:dialect:klingon\n"), config=CV04)[0]["params"]["diagnostics"]] == ["CFG"]


def test_tools():
    sql = "SELECT a.x AS y FROM (SELECT x FROM t) AS a\n"
    assert tools.run("lexer", "a b").split("\n") == ["[0] word 'a' 0..1", "[1] whitespace ' ' 1..2", "[2] word 'b' 2..3"]
    assert "select_clause:" in tools.run("parser", sql) and tools.run("format", "SELECT a  FROM t").endswith("\n")
    assert "LT12" in tools.run("lint", "SELECT 1") and tools.run("lineage", sql).split("\n")[0].startswith("y")
    assert "t" in tools.run("lineage", sql).split("\n")[-1] and tools.run("scope", sql).split("\n")[0] == "root at 0"
    assert tools.run("templater", "a {% if true %}b{% endif %}").split("\n")[0] == "a b"
    with pytest.raises(ValueError):
        tools.run("oracle", sql)
