"""HTTP over the standard library: search, stats, indexing, answers, and their pages.

``Api.handle`` is a function from a request to an answer, so it is tested
without a socket; ``serve`` puts it behind a threading server.
"""

from __future__ import annotations

import json
import mimetypes
import os
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from glosspan import arguments, reports
from glosspan.arguments import MOST_RESULTS, MOST_TERMS, ArgumentError
from glosspan.engine import Engine, is_address
from glosspan.operators import analytics
from glosspan.render import html, shapes
from glosspan.sources import files

Answer = tuple[int, str, bytes]


def as_json(data, status: int = 200) -> Answer:
    return status, "application/json", json.dumps(data, ensure_ascii=False).encode()


def as_page(content: str, status: int = 200) -> Answer:
    return status, "text/html; charset=utf-8", content.encode()


class Api:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.routes: dict[tuple[str, str], Callable[[dict], Answer]] = {
            ("GET", "/health"): lambda a: as_json({"status": "ok"}),
            ("GET", "/search"): self.search,
            ("GET", "/stats"): self.stats,
            ("POST", "/index"): self.index,
            ("POST", "/ask"): self.ask,
            ("GET", "/"): self.search_page,
            ("GET", "/ui"): self.search_page,
            ("GET", "/ui/ask"): self.answer_page,
            ("GET", "/ui/source"): self.source_page,
            ("GET", "/ui/dashboard"): lambda a: as_page(reports.dashboard(self.engine).content),
        }

    def handle(self, method: str, target: str, body: bytes = b"") -> Answer:
        """422 for bad arguments, 404 for what is not there, 405 for the wrong method."""
        url = urlsplit(target)
        path = url.path.rstrip("/") or "/"
        route = self.routes.get((method, path))
        if route is None:
            known = any(p == path for _, p in self.routes)
            return as_json({"detail": "method not allowed" if known else "not found"}, 405 if known else 404)
        try:
            asked = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            if method == "POST":
                given = json.loads(body or b"{}")
                if not isinstance(given, dict):
                    raise ArgumentError("the body must be an object")
                asked |= given
            return route(asked)
        except (ArgumentError, json.JSONDecodeError) as error:
            return as_json({"detail": str(error)}, 422)

    def _top(self, asked: dict) -> int:
        return arguments.number(asked.get("top_k"), self.engine.options.top_k, 1, MOST_RESULTS, "top_k")

    def search(self, asked: dict) -> Answer:
        query = arguments.query(asked.get("q") or asked.get("query"))
        found = self.engine.search(query, self._top(asked), asked.get("source", ""))
        return as_json(shapes.search_results(found, query, asked.get("source", "")))

    def stats(self, asked: dict) -> Answer:
        index = self.engine.index()
        made = analytics.stats(index, arguments.number(asked.get("top_terms"), 10, 0, MOST_TERMS, "top_terms"))
        return as_json(shapes.stats(made, self.engine.segments.size_bytes()))

    def index(self, asked: dict) -> Answer:
        target = asked.get("path") or asked.get("url") or ""
        force = bool(asked.get("force", False))
        if is_address(target):
            done = self.engine.index_urls(target, force=force)
        elif not os.path.exists(arguments.path(target)):
            return as_json({"detail": f"no such path: {target}"}, 404)
        else:
            done = self.engine.index_paths(target, force=force)
        return as_json(shapes.indexing(done))

    def ask(self, asked: dict) -> Answer:
        made = self.engine.answer(arguments.query(asked.get("question")), self._top(asked), asked.get("source", ""))
        return as_json(shapes.answer(made, asked.get("source", "")))

    def search_page(self, asked: dict) -> Answer:
        return as_page(reports.search(self.engine, asked.get("q", ""), self._top(asked), asked.get("source", ""), "/ui/source").content)

    def answer_page(self, asked: dict) -> Answer:
        return as_page(reports.answer(self.engine, arguments.query(asked.get("q")), self._top(asked), asked.get("source", "")).content)

    def source_page(self, asked: dict) -> Answer:
        """An indexed document: plain text as a page with the passage marked, other formats as the file; nothing else is served."""
        chunk, path = asked.get("chunk", ""), asked.get("path")
        if path is not None:
            if is_address(path) or analytics.chunks_of(self.engine.index(), path).isEmpty():
                return as_json({"detail": "not an indexed document"}, 404)
            if not path.lower().endswith(html.SHOWN):
                content = files.content_of(self.engine.spark, path)
                return as_json({"detail": "the document is no longer there"}, 404) if content is None else (200, mimetypes.guess_type(path)[0] or "application/octet-stream", content)
            made = reports.source(self.engine, chunk, asked.get("terms", "")) if chunk else None
            text = files.text_of(self.engine.spark, path) if made is None else None
            if made is None and text is not None:
                return as_page(html.document(path, text))
        else:
            made = reports.source(self.engine, chunk, asked.get("terms", ""))
        return as_json({"detail": "no such passage"}, 404) if made is None else as_page(made.content)


#: What the service makes itself; all else is a document's own content.
OWN = (as_json({})[1], as_page("")[1])


def guards(kind: str) -> dict[str, str]:
    """Headers that keep a document from running scripts against the service."""
    return {} if kind in OWN else {"Content-Security-Policy": "sandbox", "X-Content-Type-Options": "nosniff"}


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound; the caller runs ``serve_forever``."""
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, content = api.handle(self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(content)))
            for name, value in guards(kind).items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(content)

        do_GET = do_POST = answer  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
