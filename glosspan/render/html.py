"""HTML pages over collected result rows (the top k only)."""

from __future__ import annotations

from collections.abc import Iterable
from html import escape
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspan.functions import text as T
from glosspan.operators import answers
from glosspan.render import shapes, svg
from glosspan.render.text import edge_label

STYLE = """body{font:16px/1.5 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem;color:#222}
mark{background:#fe9}table{border-collapse:collapse}td,th{padding:.2rem .6rem;border-bottom:1px solid #ddd;text-align:left}
.source{color:#666;font-size:.9em}.sides{display:grid;grid-template-columns:1fr 1fr;gap:2rem}pre{white-space:pre-wrap}"""


def page(title: str, *parts: str) -> str:
    """A whole page that needs no other file."""
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{"".join(parts)}</body></html>'


def table(head: Iterable[str], rows: Iterable[Iterable]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape(str(c))}</{tag}>" for c in row)
    return f"<table><tr>{cells('th', head)}</tr>{''.join(f'<tr>{cells("td", row)}</tr>' for row in rows)}</table>"


def marked(text: str, spans: list) -> str:
    """Text with its highlights marked; spans that overlap one before are left out."""
    out, at = [], 0
    for h in sorted(spans, key=lambda h: (h["start"], h["end"])):
        if at <= h["start"] < h["end"] <= len(text):
            out += [escape(text[at : h["start"]]), "<mark>", escape(text[h["start"] : h["end"]]), "</mark>"]
            at = h["end"]
    return "".join([*out, escape(text[at:])])


#: Types whose text a server shows as a page with the passage marked.
SHOWN = (".md", ".markdown", ".txt", ".rst")


def served(endpoint: str, row) -> str:
    """Where a server shows a passage: a page of its own for plain text, the file for other formats; web pages at their address."""
    if T.web_address(row["source"]):
        return row["href"]
    at = f"{endpoint}?path={quote(row['source'], safe='')}"
    if row["source"].lower().endswith(SHOWN):
        return f"{at}&chunk={quote(row['id'])}" + (f"&terms={quote(row['terms'])}" if row["terms"] else "") + "#passage"
    return at + (f"#page={row['first_page']}" if row["first_page"] is not None else "")


def passages(found: DataFrame, endpoint: str | None = None, inlined: frozenset[int] = frozenset()) -> tuple[str, int]:
    """Result rows as a list with anchors; links go to the passage in its source, to ``endpoint`` where one serves it, or down the page where it is inlined."""
    href = F.col("href") if "href" in found.columns else T.passage_href()
    rows = found.select("rank", "id", "source", "first_page", "score", "text", "highlights", T.citation().alias("cited"), href.alias("href"), F.array_join("matched_terms", " ").alias("terms")).orderBy("rank").collect()
    out = []
    for r in rows:
        href = f"#inlined-{r['rank']}" if r["rank"] in inlined else served(endpoint, r) if endpoint else r["href"] or ""
        out.append(f'<li id="passage-{r["rank"]}" value="{r["rank"]}"><p>{marked(r["text"], r["highlights"])}</p><p class="source"><a href="{escape(href, True)}">{escape(r["cited"])}</a> ({r["score"]:.2f})</p></li>')
    return f"<ol>{''.join(out)}</ol>", len(rows)


def search(query: str, found: DataFrame | None, source: str = "", endpoint: str | None = None) -> str:
    """Results of a search; without a query, the empty form."""
    form = f'<form><input name="q" value="{escape(query, True)}"> <input name="source" value="{escape(source, True)}" placeholder="source filter"> <button>Search</button></form>'
    if found is None:
        return page("Search", form)
    body, n = passages(found, endpoint)
    scope = f" in {escape(source)}" if source else ""
    return page("Search", form, f"<p>{n} passage{'s' if n != 1 else ''}{scope}</p>", body)


def cited(spark, text: str, sources: int) -> str:
    """An answer's text with each valid citation linked to its passage."""
    row = spark.createDataFrame([(escape(text, False), sources)], "text string, n int")
    link = lambda n: F.concat(F.lit('<a href="#passage-'), n, F.lit('">['), n, F.lit("]</a>"))
    return row.select(answers.linked("text", F.col("n"), link)).first()[0]


def _answer(answer: answers.Answer, inlined: frozenset[int] = frozenset()) -> str:
    body, n = passages(answer.passages, inlined=inlined)
    text = cited(answer.passages.sparkSession, answer.text, n)
    documents = answer.documents().select("source", T.indexed_label("indexed_at").alias("at"), F.array_join("ranks", ", ").alias("ranks")).collect()
    used = ""
    if answer.usage:
        cost = "" if answer.cost_usd is None else f", ~${answer.cost_usd:.4f}"
        used = f'<p class="source">{escape(answer.usage.model)}: {answer.usage.input_tokens:,} input tokens, {answer.usage.output_tokens:,} output tokens{cost}</p>'
    return f"<pre>{text}</pre>{used}<h2>Passages</h2>{body}<h2>Documents</h2>{table(('Document', 'Indexed', 'Passages'), documents)}"


def answer(made: answers.Answer) -> str:
    return page(made.question, _answer(made))


def self_contained(made: answers.Answer, documents: DataFrame) -> str:
    """An answer with the documents it cites (source, text, segments) in the page, each cited stretch marked where it stands.

    A document that could not be read is linked, as in a plain report.
    """
    rows = documents.orderBy("source").collect()  # those of the top k passages
    ranks = frozenset(rank for r in rows for s in r["segments"] for rank in s["ranks"])
    out = []
    for r in rows:
        body, at = [], 0
        for s in sorted(r["segments"], key=lambda s: s["start"]):
            anchors = "".join(f'<span id="inlined-{n}"></span>' for n in sorted(s["ranks"]))
            body += [escape(r["text"][at : s["start"]]), anchors, f'<section class="passage">{marked(r["text"][s["start"] : s["end"]], s["highlights"])}</section>']
            at = s["end"]
        out.append(f'<article><h3>{escape(r["source"])}</h3><pre>{"".join(body)}{escape(r["text"][at:])}</pre></article>')
    head = f"<h2>Cited texts</h2><p>{len(rows)} document{'' if len(rows) == 1 else 's'} inlined</p>" if rows else ""
    return page(made.question, _answer(made, ranks), head, *out)


def comparison(made: answers.Comparison) -> str:
    sides = "".join(f"<section><h2>{escape(v.label)}</h2>{_answer(v.answer)}</section>" for v in (made.left, made.right))
    return page(made.question, f"<p>{len(made.shared)} shared passages, overlap {made.overlap:.2f}</p>", f'<div class="sides">{sides}</div>')


def _stats(stats: DataFrame) -> str:
    row = stats.first()
    counts = table(("Documents", "Chunks", "Terms", "Vocabulary"), [(row["documents"], row["chunks"], row["terms"], row["vocabulary"])])
    return counts + svg.bars([(t["term"], t["count"]) for t in row["top_terms"]], "Most frequent terms")


def stats(made: DataFrame) -> str:
    return page("Index", _stats(made))


def dashboard(tables: dict[str, DataFrame], most_points: int = 2000) -> str:
    """The overview's tables as charts; of a map with more points, a sample by a hash of their ids, which the page says."""
    types = [(r["type"], r["documents"]) for r in tables["types"].collect()]
    lengths = [(f"{r['low']}-{r['high']}", r["count"]) for r in tables["lengths"].collect()]
    links = [(r["first"], r["second"], r["strength"], r["edge"]) for r in tables["relations"].withColumn("edge", edge_label()).collect()]
    recent = tables["recent"].select("source", T.indexed_label("indexed_at"), "chunks").collect()
    spots = [(r["id"], r["source"], r["x"], r["y"]) for r in shapes.sampled(tables["map"], most_points + 1).collect()]
    shown = f"Chunks by content, a sample of {most_points:,}" if len(spots) > most_points else "Chunks by content"
    parts = [_stats(tables["stats"]), "<h2>Types</h2>", svg.bars(types, "Documents by type"), "<h2>Chunk lengths</h2>", svg.columns(lengths, "Words in a chunk")]
    parts += ["<h2>Relations</h2>", svg.network(links, "Shared terms"), "<h2>Map</h2>", svg.points(spots[:most_points], shown), "<h2>Recent documents</h2>", table(("Document", "Indexed", "Chunks"), recent)]
    return page("Dashboard", *parts)


def evaluation(outcomes: DataFrame, report: DataFrame) -> str:
    total = report.first()
    rows = [(r["query_id"], "miss" if r["first_hit"] is None else r["first_hit"], f"{r['recall_curve'][-1]:.2f}") for r in outcomes.orderBy("query_id").collect()]
    curve = svg.columns([(str(i), round(v, 3)) for i, v in enumerate(total["mean_curve"], 1)], "Mean recall by rank")
    return page("Evaluation", f"<p>recall {total['recall']:.2f}, MRR {total['mrr']:.2f} over {total['cases']} cases</p>", curve, table(("Case", "First hit", "Recall"), rows))


def document(source: str, text: str) -> str:
    return page(source, f"<pre>{escape(text)}</pre>")


def source(made: DataFrame) -> str | None:
    """A document with one passage framed and its highlights marked; None without a row."""
    row = made.first()
    if row is None:
        return None
    a, b = (row["passage_start"], row["passage_end"]) if row["passage_start"] is not None else (0, 0)
    inside = [{"start": h["start"] - a, "end": h["end"] - a} for h in row["highlights"] or []]
    body = f'{escape(row["text"][:a])}<section id="passage">{marked(row["text"][a:b], inside)}</section>{escape(row["text"][b:])}'
    return page(row["source"], f"<pre>{body}</pre>")
