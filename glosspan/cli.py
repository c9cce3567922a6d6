"""Command line: index, watch, remove, search, ask, compare, chat, stats, dashboard, evaluate, report, serve, mcp."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import tempfile
import webbrowser
from dataclasses import replace
from pathlib import Path

from glosspan import __version__, arguments, reports
from glosspan.engine import Engine, is_address
from glosspan.render import shapes
from glosspan.render import text as render
from glosspan.session import session
from glosspan.sources import settings


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glosspan")
    top.add_argument("--index", help="folder of the index")
    top.add_argument("--config", help="settings as TOML")
    top.add_argument("--retriever", choices=("bm25", "embedding", "hybrid"))
    top.add_argument("--rerank", action="store_true", default=None)
    top.add_argument("-v", "--verbose", action="store_true", help="log what is done to standard error")
    top.add_argument("--version", action="version", version=f"glosspan {__version__}")
    todo = top.add_subparsers(dest="command", required=True)
    for name, words in (("index", "+"), ("watch", "+"), ("remove", "+")):
        sub = todo.add_parser(name)
        sub.add_argument("targets", nargs=words)
        if name == "index":
            sub.add_argument("--force", action="store_true")
        if name == "watch":
            sub.add_argument("--ignore", action="append", default=[], help="a folder that is not watched")
    for name in ("search", "ask"):
        sub = todo.add_parser(name)
        sub.add_argument("query")
        sub.add_argument("-k", "--top-k", type=int)
        sub.add_argument("--source", default="")
        sub.add_argument("--json", action="store_true")
        if name == "ask":
            sub.add_argument("--usage", action="store_true")
    for name in ("chat", "stats", "mcp"):
        todo.add_parser(name)
    sub = todo.add_parser("dashboard")
    sub.add_argument("--html", help="file to write the page to")
    sub = todo.add_parser("compare")
    sub.add_argument("query")
    sub.add_argument("changes", nargs="+", help="settings of the other side, as key=value")
    sub.add_argument("--source", default="")
    sub = todo.add_parser("report")
    sub.add_argument("query")
    sub.add_argument("-o", "--output", help="an .html or .md file")
    sub.add_argument("--format", choices=("html", "markdown", "self-contained"), help="self-contained: a page that holds the cited documents")
    sub.add_argument("--open", action="store_true", help="open the report in a browser")
    sub.add_argument("-k", "--top-k", type=int)
    sub.add_argument("--source", default="")
    sub = todo.add_parser("serve")
    sub.add_argument("--host", default="127.0.0.1")
    sub.add_argument("--port", type=int, default=8000)
    sub = todo.add_parser("evaluate")
    sub.add_argument("cases")
    sub.add_argument("-k", type=int, default=5)
    return top


def dumped(shape) -> str:
    return json.dumps(shape, indent=2, ensure_ascii=False)


def written(content: str, args, name: str, suffix: str) -> None:
    """A report to the file asked for, with ``--open`` to a temporary one, else to standard output; then to the browser if asked."""
    output = Path(args.output) if args.output else None
    if output is None and args.open:
        output = Path(tempfile.mkdtemp(prefix="glosspan-")) / f"{name}.{suffix}"
    if output is None:
        print(content)
        return
    output.parent.mkdir(parents=True, exist_ok=True)
    output.write_text(content, "utf-8")
    if args.open and not webbrowser.open(output.resolve().as_uri()):
        print(f"no browser could be opened; the report is at {output}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verbose:
        logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(message)s")
    config = args.config or settings.discovered()
    try:
        options = settings.read(config) if config else settings.Settings()
    except settings.SettingsError as error:
        print(error, file=sys.stderr)
        return 2
    given = {"index_path": args.index, "retriever": args.retriever, "rerank": args.rerank}
    engine = Engine(session(), replace(options, **{k: v for k, v in given.items() if v is not None}))
    logging.getLogger(__name__).info(logged("command", name=args.command, index=engine.options.index_path))
    try:
        return globals()[f"run_{args.command}"](engine, args)
    except (settings.SettingsError, arguments.ArgumentError) as error:
        print(error, file=sys.stderr)
        return 2


def logged(event: str, **values) -> str:
    """``event key=value ...``; values with blanks or quotes are quoted."""
    quoted = lambda v: json.dumps(v, ensure_ascii=False) if not v or any(c in v for c in ' "=\n') else v
    return " ".join([event, *(f"{k}={quoted(str(v))}" for k, v in values.items())])


def run_index(engine: Engine, args) -> int:
    urls = [t for t in args.targets if is_address(t)]
    paths = [t for t in args.targets if t not in urls]
    done = engine.index_paths(*paths, force=args.force)
    if urls:
        done += engine.index_urls(*urls, force=args.force)
    print(f"{done.indexed} indexed, {done.unchanged} unchanged, {done.chunks} chunks, {len(done.skipped)} skipped")
    for source, reason in done.failed:
        print(f"failed: {source}: {reason}", file=sys.stderr)
    return int(bool(done.failed))


def run_watch(engine: Engine, args) -> int:
    engine.watch(*args.targets, ignored=args.ignore).start().awaitTermination()
    return 0


def run_remove(engine: Engine, args) -> int:
    gone = sum(engine.remove(t) for t in args.targets)
    print(f"{gone} removed")
    return int(not gone)


def run_search(engine: Engine, args) -> int:
    found = engine.search(arguments.query(args.query), arguments.number(args.top_k, engine.options.top_k, 1, arguments.MOST_RESULTS, "top_k"), args.source)
    found = engine.held(found)
    print(dumped(shapes.search_results(found, args.query, args.source)) if args.json else render.results(found) or "nothing found")
    return int(found.isEmpty())


def run_ask(engine: Engine, args) -> int:
    made = engine.answer(arguments.query(args.query), args.top_k, args.source)
    sources = [f"[{r['rank']}] {r['source']}" for r in made.passages.orderBy("rank").collect()]
    usage = None if made.usage is None else vars(made.usage) | {"cost_usd": made.cost_usd}
    if args.json:
        print(dumped(shapes.answer(made, args.source)))
    else:
        print("\n".join([made.text, "", *sources, *([logged("usage", **usage)] if args.usage and usage else [])]))
    return 0


def run_compare(engine: Engine, args) -> int:
    print(reports.comparison(engine, arguments.query(args.query), *args.changes, source=args.source, form="text").content)
    return 0


def run_report(engine: Engine, args) -> int:
    form = args.format or ("markdown" if args.output and args.output.endswith(".md") else "html")
    content = reports.answer(engine, arguments.query(args.query), args.top_k, args.source, form).content
    written(content, args, "answer", "md" if form == "markdown" else "html")
    return 0


def run_serve(engine: Engine, args) -> int:
    from glosspan.serve import http

    with http.serve(engine, args.host, args.port) as server:
        print(f"http://{args.host}:{server.server_address[1]}")
        server.serve_forever()
    return 0


def run_mcp(engine: Engine, args) -> int:
    from glosspan.serve import mcp

    mcp.Server(engine, lambda message: print(json.dumps(message), flush=True)).run()
    return 0


def run_chat(engine: Engine, args) -> int:
    chat = engine.chat()
    for line in sys.stdin:
        line = line.strip()
        if line in ("/exit", "/quit"):
            break
        if line == "/reset":
            chat.reset()
        elif line:
            print(chat.ask(line))
    return 0


def run_stats(engine: Engine, args) -> int:
    print(dumped(shapes.stats(engine.overview()["stats"], engine.segments.size_bytes())))
    return 0


def run_dashboard(engine: Engine, args) -> int:
    if args.html:
        Path(args.html).write_text(reports.dashboard(engine).content, "utf-8")
    else:
        print(reports.dashboard(engine, "text").content)
    return 0


def run_evaluate(engine: Engine, args) -> int:
    try:
        cases = settings.cases(engine.spark, args.cases)
    except settings.CaseSetError as error:
        print(error, file=sys.stderr)
        return 2
    print(render.evaluation(*engine.evaluate(cases, args.k)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
