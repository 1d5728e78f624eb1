"""Tools by JSON-RPC 2.0, one message a line on standard input and output, as the Model Context Protocol has it.

    python -m tidemark.servers.tools [folder of Parquet tables]

Answers hold at most MOST_ROWS rows of a result and say whether there are more.
"""

from __future__ import annotations

import json
import os
import sys

from tidemark.engine import Engine
from tidemark.servers.pgwire import text

MOST_ROWS = 1_000

_T, _N = {"type": "string"}, {"type": "integer"}
#: Name: (what it does, arguments, those that are needed).
TOOLS = {
    "query": ("Runs SQL; the rows of its last statement.", {"sql": _T}, ["sql"]),
    "load_url": ("A JSON, CSV or Parquet file as a table.", {"name": _T, "url": _T, "path": {"type": "array", "items": _T}}, ["name", "url"]),
    "load_iceberg": ("An Iceberg table as a table.", {"name": _T, "location": _T}, ["name", "location"]),
    "list_tables": ("Tables and views.", {}, []),
    "describe_table": ("A table's columns.", {"name": _T}, ["name"]),
    "similarity_search": ("The k rows nearest to a vector.", {"table": _T, "column": _T, "vector": {"type": "array", "items": {"type": "number"}}, "k": _N, "metric": _T}, ["table", "column", "vector", "k"]),
    "reset": ("Forgets all objects.", {}, []),
}


def _rows(df) -> dict:
    found = df.limit(MOST_ROWS + 1).collect()
    plain = lambda x: x if x is None or isinstance(x, (bool, int, float, str)) else text(x)
    return {"columns": df.columns, "rows": [[plain(x) for x in r] for r in found[:MOST_ROWS]], "more": len(found) > MOST_ROWS}


def call(engine: Engine, name: str, a: dict) -> dict:
    if name == "query":
        out = engine.sql(a["sql"])
        return {"tag": out.tag} if out.df is None else _rows(out.df)
    if name == "load_url":
        engine.load_url(a["name"], a["url"], *a.get("path", []))
    elif name == "load_iceberg":
        engine.load_iceberg(a["name"], a["location"])
    elif name == "list_tables":
        return _rows(engine.list_tables())
    elif name == "describe_table":
        return _rows(engine.describe_table(a["name"]))
    elif name == "similarity_search":
        return _rows(engine.similarity_search(a["table"], a["column"], a["vector"], int(a["k"]), a.get("metric", "<->")))
    else:
        engine.reset()
    return {"ok": True}


def answer(engine: Engine, line: str) -> str | None:
    """The reply to one message; None for notifications."""
    try:
        asked = json.loads(line)
    except json.JSONDecodeError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}})
    method, given, number = asked.get("method"), asked.get("params") or {}, asked.get("id")
    if number is None:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        reply["result"] = {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tidemark", "version": "1"}}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    elif method == "tools/call" and given.get("name") in TOOLS:
        try:
            out, failed = call(engine, given["name"], given.get("arguments") or {}), False
        except Exception as e:  # noqa: BLE001  the caller gets every failure
            out, failed = {"error": f"{type(e).__name__}: {e}"}, True
        reply["result"] = {"content": [{"type": "text", "text": json.dumps(out)}], "isError": failed}
    else:
        reply["error"] = {"code": -32601, "message": f"unknown method or tool {given.get('name', method)!r}"}
    return json.dumps(reply)


def main() -> None:
    from tidemark import session

    engine = Engine(session.session())
    if folder := (sys.argv[1:2] or [None])[0]:
        engine.load(folder, [f.removesuffix(".parquet") for f in sorted(os.listdir(folder)) if f.endswith(".parquet")])
    for line in sys.stdin:
        if line.strip() and (out := answer(engine, line)) is not None:
            print(out, flush=True)


if __name__ == "__main__":
    main()
