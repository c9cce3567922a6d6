"""Reports: data of an engine's services with their rendered content."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from glosspan.engine import Engine
from glosspan.operators import analytics
from glosspan.render import html, markdown
from glosspan.render import text as plain


@dataclass(frozen=True)
class Rendered:
    """What was found, and what it looks like."""

    data: Any
    content: str


#: Replaceable renderers by report and form; each takes the report's data.
RENDERERS: dict[tuple[str, str], Callable[..., str]] = {
    ("answer", "html"): html.answer, ("answer", "markdown"): markdown.answer, ("answer", "self-contained"): lambda made: html.self_contained(*made),
    ("comparison", "html"): html.comparison, ("comparison", "text"): markdown.comparison,
    ("stats", "html"): html.stats, ("dashboard", "html"): html.dashboard, ("dashboard", "text"): plain.dashboard,
    ("evaluation", "html"): lambda made: html.evaluation(*made), ("evaluation", "text"): lambda made: plain.evaluation(*made),
}


def rendered(name: str, form: str, data: Any, engine: Engine | None = None) -> Rendered:
    known = RENDERERS | (engine.ports.renderers if engine else {})
    if (name, form) not in known:
        raise ValueError(f"no {form} form of {name}")
    return Rendered(data, known[name, form](data))


def search(engine: Engine, query: str, top_k: int | None = None, source: str = "", endpoint: str | None = None) -> Rendered:
    """A blank query gives the empty page and searches nothing."""
    found = engine.held(engine.search(query, top_k, source)) if query.strip() else None
    return Rendered(found, html.search(query.strip(), found, source, endpoint))


def answer(engine: Engine, question: str, top_k: int | None = None, source: str = "", form: str = "html") -> Rendered:
    """``form`` is html, markdown, or self-contained: a page that holds the cited documents, too."""
    made = engine.answer(question, top_k, source)
    return rendered("answer", form, (made, engine.cited_texts(made)) if form == "self-contained" else made, engine)


def comparison(engine: Engine, question: str, *pairs: str, source: str = "", form: str = "html") -> Rendered:
    return rendered("comparison", form, engine.comparison(question, *pairs, source=source), engine)


def stats(engine: Engine, terms: int = 10) -> Rendered:
    return rendered("stats", "html", analytics.stats(engine.index(), terms), engine)


def dashboard(engine: Engine, form: str = "html") -> Rendered:
    return rendered("dashboard", form, engine.overview(), engine)


def evaluation(engine: Engine, cases, k: int = 5, form: str = "html") -> Rendered:
    return rendered("evaluation", form, engine.evaluate(cases, k), engine)


def source(engine: Engine, chunk_id: str, query: str = "") -> Rendered | None:
    """None for an unknown chunk or a source that cannot be read."""
    made = engine.source_page(chunk_id, query=query)
    content = html.source(made)
    return None if content is None else Rendered(made, content)
