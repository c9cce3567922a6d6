"""Tools, resources and prompts for language models: JSON-RPC messages, one a line.

``Server.handle`` answers one message; ``run`` reads lines until they end.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from typing import TextIO

from glosspan import arguments
from glosspan.arguments import MOST_RESULTS, MOST_TERMS, ArgumentError
from glosspan.engine import Engine
from glosspan.functions import text as T
from glosspan.operators import analytics, answers
from glosspan.render import shapes
from glosspan.render import text as plain
from glosspan.streaming import events

VERSION = "2025-06-18"
#: Characters of documents that a prompt holds.
PROMPT_BUDGET = 60_000
#: Documents that the list of documents names.
MOST_DOCUMENTS = 10_000
TEXT, NUMBER, YES_NO = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}


def schema(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required}


class Server:
    def __init__(self, engine: Engine, announce: Callable[[dict], None] | None = None):
        self.engine, self.announce = engine, announce or (lambda message: None)
        #: By tool: what it does, its arguments, and the function from arguments to (text, data).
        self.tools: dict[str, tuple[str, dict, Callable[[dict], tuple[str, dict]]]] = {
            "search_documents": ("Passages that answer a query", schema(["query"], query=TEXT, top_k=NUMBER, source=TEXT), self.search),
            "ask_documents": ("An answer from the indexed passages", schema(["question"], question=TEXT, top_k=NUMBER, source=TEXT), self.ask),
            "index_path": ("Index a file or folder", schema(["path"], path=TEXT, force=YES_NO), lambda a: self.indexed(self.engine.index_paths(arguments.path(a.get("path")), force=bool(a.get("force"))))),
            "index_url": ("Index a web page", schema(["url"], url=TEXT, force=YES_NO), lambda a: self.indexed(self.engine.index_urls(arguments.address(a.get("url")), force=bool(a.get("force"))))),
            "remove_path": ("Remove a file or folder from the index", schema(["path"], path=TEXT), lambda a: self.removed(arguments.path(a.get("path")))),
            "remove_url": ("Remove a web page from the index", schema(["url"], url=TEXT), lambda a: self.removed(arguments.address(a.get("url")))),
            "index_stats": ("What the index holds", schema([], top_terms=NUMBER), self.stats),
            "index_dashboard": ("An overview of the index", schema([]), lambda a: (plain.dashboard(self.engine.overview()), {})),
        }
        self.methods: dict[str, Callable[[dict], dict]] = {
            "initialize": lambda p: {"protocolVersion": VERSION, "serverInfo": {"name": "glosspan", "version": "1"}, "capabilities": {"tools": {}, "resources": {"listChanged": True}, "prompts": {}}},
            "ping": lambda p: {},
            "tools/list": lambda p: {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in self.tools.items()]},
            "tools/call": self.call,
            "resources/list": lambda p: {"resources": [{"uri": "glosspan://documents", "name": "documents", "mimeType": "application/json"}]},
            "resources/templates/list": lambda p: {"resourceTemplates": [{"uriTemplate": "glosspan://chunks/{id}", "name": "chunk", "mimeType": "application/json"}]},
            "resources/read": self.read,
            "prompts/list": lambda p: {"prompts": [{"name": "summarize_document", "arguments": [{"name": "source", "required": True}]}, {"name": "compare_documents", "arguments": [{"name": n, "required": True} for n in ("first", "second")]}]},
            "prompts/get": self.prompt,
        }

    def handle(self, message: dict) -> dict | None:
        """The answer; None for a notification."""
        if "id" not in message:
            return None
        out = {"jsonrpc": "2.0", "id": message["id"]}
        method = self.methods.get(message.get("method", ""))
        if method is None:
            return out | {"error": {"code": -32601, "message": f"unknown method {message.get('method')}"}}
        try:
            return out | {"result": method(message.get("params") or {})}
        except ArgumentError as error:
            return out | {"error": {"code": -32602, "message": str(error)}}

    def run(self, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
        for line in lines:
            if line.strip():
                try:
                    answer = self.handle(json.loads(line))
                except json.JSONDecodeError as error:
                    answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(error)}}
                if answer is not None:
                    print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)

    # Tools: bad arguments are results that say so, so that a model can try again.

    def call(self, params: dict) -> dict:
        if params.get("name") not in self.tools:
            raise ArgumentError(f"unknown tool {params.get('name')}")
        try:
            text, data = self.tools[params["name"]][2](params.get("arguments") or {})
        except ArgumentError as error:
            return {"content": [{"type": "text", "text": str(error)}], "isError": True}
        return {"content": [{"type": "text", "text": text}], "structuredContent": data, "isError": False}

    def _found(self, asked: dict, key: str) -> tuple[str, int, str]:
        top = arguments.clamped(asked.get("top_k"), self.engine.options.top_k, 1, MOST_RESULTS, "top_k")
        return arguments.query(asked.get(key)), top, asked.get("source") or ""

    def search(self, asked: dict) -> tuple[str, dict]:
        query, top, source = self._found(asked, "query")
        found = self.engine.held(self.engine.search(query, top, source))
        return plain.results(found) or "nothing found", shapes.search_results(found, query, source)

    def ask(self, asked: dict) -> tuple[str, dict]:
        question, top, source = self._found(asked, "question")
        made = self.engine.answer(question, top, source)
        cited = [r[0] for r in made.passages.orderBy("rank").select(T.citation()).collect()]
        lines = [made.text, "", *(f"[{i}] {c}" for i, c in enumerate(cited, 1))]
        return "\n".join(lines), shapes.answer(made, source)

    def indexed(self, done) -> tuple[str, dict]:
        if done.indexed:
            self.changed()
        return f"{done.indexed} indexed, {done.unchanged} unchanged, {done.chunks} chunks, {len(done.skipped)} skipped, {len(done.failed)} failed", shapes.indexing(done)

    def removed(self, target: str) -> tuple[str, dict]:
        gone = self.engine.remove(target)
        if gone:
            self.changed()
        return f"{gone} removed", {"removed": gone}

    def changed(self) -> None:
        """Clients hear that the list has changed before they hear which resource has."""
        self.announce({"jsonrpc": "2.0", "method": "notifications/resources/list_changed"})
        self.announce({"jsonrpc": "2.0", "method": "notifications/resources/updated", "params": {"uri": "glosspan://documents"}})

    def stats(self, asked: dict) -> tuple[str, dict]:
        made = analytics.stats(self.engine.index(), arguments.clamped(asked.get("top_terms"), 10, 0, MOST_TERMS, "top_terms"))
        data = plain.objects(made)[0]
        return f"{data['documents']} documents, {data['chunks']} chunks, {data['terms']} terms", data

    def watch(self, *roots: str, interval: str = "1 second"):
        """Follow folders in the background; batches that bring changes are announced, and so is the end of the watching, also by an error."""
        watcher = self.engine.watch(*roots)
        streams = self.engine.spark.streams

        def tell(event: str, details: dict) -> None:
            if event == events.UPDATED:
                self.changed()
            elif event == events.STOPPED:
                self.announce({"jsonrpc": "2.0", "method": "notifications/message", "params": {"level": "error" if details["error"] else "info", "logger": "watch", "data": {"roots": list(roots), "error": details["error"]}}})

        announcer = events.Announcer(tell, watcher.name, done=lambda: streams.removeListener(announcer))
        streams.addListener(announcer)
        query = watcher.start(interval)
        announcer.follow(query.runId)
        return query

    # Resources and prompts.

    def read(self, params: dict) -> dict:
        uri, index = params.get("uri", ""), self.engine.index()
        if uri == "glosspan://documents":
            body = shapes.documents(analytics.catalog(index).orderBy("source").limit(MOST_DOCUMENTS))
        elif uri.startswith("glosspan://chunks/"):
            found = shapes.chunk(analytics.chunk(index, uri.rpartition("/")[2]))
            if not found:
                raise ArgumentError(f"no such chunk: {uri}")
            body = found[0]
        else:
            raise ArgumentError(f"no such resource: {uri}")
        return {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(body, ensure_ascii=False)}]}

    def prompt(self, params: dict) -> dict:
        given = params.get("arguments") or {}
        if params.get("name") == "summarize_document":
            sources, task = [given.get("source")], "Summarize this document."
        elif params.get("name") == "compare_documents":
            sources, task = [given.get("first"), given.get("second")], "Compare these documents: what they share and where they differ."
        else:
            raise ArgumentError(f"unknown prompt {params.get('name')}")
        parts = [self.document(arguments.query(s), PROMPT_BUDGET // len(sources)) for s in sources]
        return {"messages": [{"role": "user", "content": {"type": "text", "text": "\n\n".join([task, *parts])}}]}

    def document(self, source: str, budget: int) -> str:
        """A document's leading passages as far as the budget goes, and how many are left out."""
        rows = answers.budgeted(analytics.chunks_of(self.engine.index(), source), budget).orderBy("position").select("text", "omitted").collect()
        if not rows:
            raise ArgumentError(f"no such document: {source}")
        left = [f"({rows[0]['omitted']} passages left out)"] if rows[0]["omitted"] else []
        return "\n\n".join([f"Document: {source}", *(r["text"] for r in rows), *left])
