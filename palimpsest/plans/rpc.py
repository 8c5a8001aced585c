"""A line-oriented JSON-RPC server with two tools, clean and map_list. Restoring is no tool."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from palimpsest.config import Config
from palimpsest.operators.vault import Vault
from palimpsest.plans.clean import clean
from palimpsest.plans.files import parts_of
from palimpsest.sources.formats import ConversionError, format_of, supported

#: Protocol versions that are spoken, latest last. Fixed values.
VERSIONS = ("2025-06-18", "2025-11-25")
TOOLS = [
    {"name": "clean", "description": "Read a file and return its text with sensitive values replaced by placeholders.", "inputSchema": {"type": "object", "properties": {"path": {"type": "string"}}, "required": ["path"]}},
    {"name": "map_list", "description": "List the placeholders in use, without their values.", "inputSchema": {"type": "object", "properties": {}}},
]
#: One answer for every path that isn't served, whether or not it exists.
NOT_SERVED, FAILED = "this path is not available", "the file could not be cleaned"
MISSING, NOT_TEXT, NOTHING = "this path does not exist", "the file is not valid UTF-8", "no placeholder is in use"
NOT_READ = "the file could not be read as {}; it may be damaged or hold no text"


class Roots:
    """Folders that are served; None serves all."""

    def __init__(self, roots: list[str] | None):
        self.roots = None if roots is None else [os.path.realpath(r) for r in roots]

    def admit(self, path: str) -> str | None:
        """The path with .. folded and links followed, if it lies within a root by whole components."""
        real = os.path.realpath(os.path.normpath(os.path.abspath(path)))
        return real if self.roots is None or any(os.path.commonpath([real, r]) == r for r in self.roots) else None


class Server:
    def __init__(self, spark: SparkSession, config: Config, store: Vault, roots: Roots):
        self.spark, self.config, self.store, self.roots = spark, config, store, roots

    def clean(self, path: str) -> tuple[str, bool]:
        """The cleaned text, or what is wrong, told from a closed set of causes: nothing of the file is in a message."""
        real = self.roots.admit(path)
        if real is None or not os.path.isfile(real):
            return (MISSING if self.roots.roots is None else NOT_SERVED), True
        fmt = format_of(real)
        if fmt is None:
            return f"files of this type aren't read; supported are {', '.join(supported(False))}", True
        try:
            parts = parts_of(self.spark, [real])[0].orderBy("part_ord").collect()
        except ConversionError:
            return (NOT_TEXT if fmt in ("text", "csv", "tsv") else NOT_READ.format(fmt)), True
        except Exception:
            return FAILED, True
        try:
            rows = [(k, t) for p in parts for k, t in ((2 * p.part_ord, p.sheet_name), (2 * p.part_ord + 1, p.text)) if t is not None]
            done = clean(self.spark.createDataFrame(rows, "doc_id long, text string"), self.config, self.store)
            text = {r.doc_id: r.text for r in done.collect()}
            return "\n".join(f"## {text[k]}" if k % 2 == 0 else text[k] for k in sorted(text)), False
        except Exception:
            return FAILED, True

    def call(self, name: str, given: dict) -> tuple[str, bool]:
        if name == "clean":
            return self.clean(given["path"]) if isinstance(given.get("path"), str) else ("clean needs the path of a file as a string", True)
        if name == "map_list":
            return "\n".join(f"[[{r.tag}_{r.seq}]]" for r in self.store.entries().collect()) or NOTHING, False
        return f"unknown tool: {name}", True

    def handle(self, line: str) -> str | None:
        """The answer to one message; none to a notification. A bad message never ends the loop."""
        def fault(id, code: int, text: str) -> str:
            """An id that couldn't be read is left out, never null."""
            return json.dumps({"jsonrpc": "2.0", **({} if id is None else {"id": id}), "error": {"code": code, "message": text}})

        try:
            m = json.loads(line)
        except ValueError:
            return fault(None, -32700, "parse error")
        if not isinstance(m, dict) or not isinstance(m.get("method"), str):
            return fault(m.get("id") if isinstance(m, dict) else None, -32600, "batches and malformed requests are not supported")
        if "id" not in m:
            return None
        given, method = m.get("params"), m["method"]
        if method in ("initialize", "tools/call") and not isinstance(given, dict):
            return fault(m["id"], -32602, f"{method} needs a params object")
        given = given or {}
        if method == "initialize":
            asked = given.get("protocolVersion")
            result = {"protocolVersion": asked if asked in VERSIONS else VERSIONS[-1], "capabilities": {"tools": {}}, "serverInfo": {"name": "palimpsest", "version": "0.1.0"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": TOOLS}
        elif method == "tools/call":
            text, failed = self.call(str(given.get("name")), given.get("arguments") or {})
            result = {"content": [{"type": "text", "text": text}], "isError": failed}
        else:
            return fault(m["id"], -32601, f"unknown method: {method}")
        return json.dumps({"jsonrpc": "2.0", "id": m["id"], "result": result}, ensure_ascii=False)

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip() and (answer := self.handle(line)):
                yield answer
