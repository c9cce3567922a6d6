"""Plain-text, Markdown and Mermaid views over collected result rows (the top k only)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosspan.functions import text as T


def objects(rows: DataFrame) -> list[dict]:
    """Few rows as JSON shapes; empty fields are left out."""
    return [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect()]


def labels(sources: DataFrame) -> DataFrame:
    """(source, label): the file name, or the whole path where names clash."""
    name = F.element_at(F.split(F.regexp_replace("source", r"\\", "/"), "/"), -1)
    rows = sources.select("source").distinct().withColumn("name", name)
    shared = F.count(F.lit(1)).over(W.partitionBy("name"))
    return rows.select("source", F.when(shared > 1, F.regexp_replace("source", r"\\", "/")).otherwise(F.col("name")).alias("label"))


def edge_label(terms: str = "shared_terms", most: int = 3):
    more = F.size(terms) - most
    return F.concat(F.array_join(F.slice(terms, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more)).otherwise(""))


def results(rows: DataFrame) -> str:
    """One paragraph per result row (rank, score, source, text), with what its score is made of where that is known."""
    parts = T.breakdown("contributions") if "contributions" in rows.columns else F.lit(None)
    out = []
    for r in rows.select("rank", "score", "source", T.preview("text", 160).alias("text"), parts.alias("parts")).orderBy("rank").collect():
        out.append(f"{r['rank']}. {r['source']} ({r['score']:.2f})\n   {r['text']}" + (f"\n   {r['parts']}" if r["parts"] else ""))
    return "\n\n".join(out)


def bars(rows: DataFrame, label: str, value: str, width: int = 40) -> str:
    """A bar chart of few rows."""
    found = rows.collect()
    top = max((r[value] for r in found), default=0) or 1
    pad = max((len(str(r[label])) for r in found), default=0)
    return "\n".join(f"{r[label]!s:<{pad}} {'#' * max(1, round(width * r[value] / top))} {r[value]}" for r in found)


def mermaid(relations: DataFrame) -> str:
    """A graph of document relations (first, second, shared_terms)."""
    rows = relations.withColumn("edge", edge_label()).collect()
    names = sorted({r[c] for r in rows for c in ("first", "second")})
    ids = {n: f"d{i}" for i, n in enumerate(names)}
    quoted = lambda s: s.replace('"', "#quot;")
    lines = ["graph LR", *(f'  {ids[n]}["{quoted(n)}"]' for n in names), *(f'  {ids[r["first"]]} ---|"{quoted(r["edge"])}"| {ids[r["second"]]}' for r in rows)]
    return "\n".join(lines)


def grid(points: DataFrame, width: int = 48, height: int = 14) -> str:
    """A map of points (label, x, y in -1..1); several in one cell are a star."""
    cells: dict[tuple[int, int], str] = {}
    for r in points.collect():
        at = (round((1 - r["y"]) / 2 * (height - 1)), round((r["x"] + 1) / 2 * (width - 1)))
        cells[at] = "*" if at in cells and cells[at] != r["label"] else r["label"]
    return "\n".join("".join(cells.get((i, j), " ") for j in range(width)).rstrip() for i in range(height))


def evaluation(outcomes: DataFrame, report: DataFrame) -> str:
    total = report.first()
    lines = [f"{r['query_id']}: {'miss' if r['first_hit'] is None else 'rank ' + str(r['first_hit'])}" for r in outcomes.orderBy("query_id").collect()]
    return "\n".join([*lines, f"recall {total['recall']:.2f}, MRR {total['mrr']:.2f} over {total['cases']} cases"])


def dashboard(tables: dict[str, DataFrame], most_points: int = 2000) -> str:
    """The overview's tables as plain text; documents go by their short labels, the map's letters by document."""
    row = tables["stats"].first()
    named = {r["source"]: r["label"] for r in labels(tables["recent"]).collect()}
    recent = [f"{named[r['source']]}: {r['at']}, {r['size']}" for r in tables["recent"].select("source", T.indexed_label("indexed_at").alias("at"), T.plural("chunks", "chunk").alias("size")).collect()]
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(F.xxhash64("source"), F.lit(26)) + 1).cast("int"), F.lit(1))
    spots = tables["map"].orderBy("id").limit(most_points).select(letter.alias("label"), "x", "y")
    parts = [f"{row['documents']} documents, {row['chunks']} chunks, {row['terms']} terms, {row['vocabulary']} different", bars(tables["types"], "type", "documents"), bars(tables["lengths"], "low", "count"), mermaid(tables["relations"]), grid(spots), "\n".join(recent)]
    return "\n\n".join(parts)
