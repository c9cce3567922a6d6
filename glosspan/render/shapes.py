"""The stated JSON shape of each result, shared by command line, HTTP and tool server.

Shapes with rows come from a ``select`` of named columns, so a field is there
also where it is null or empty.  Only results of bounded size (the top k, one
report, one page of a catalog) are turned into shapes.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspan.functions import text as T

KEEP_NULLS = {"ignoreNullFields": "false"}


def shaped(rows: DataFrame, *fields: Column | str) -> list[dict]:
    return [json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*fields), KEEP_NULLS)).collect()]


def chunk_fields() -> Column:
    return F.struct("id", "source", "position", "first_page", "last_page", "section", T.citation().alias("citation"), "text").alias("chunk")


def chunk(rows: DataFrame) -> list[dict]:
    return [r["chunk"] for r in shaped(rows, chunk_fields())]


def search_results(found: DataFrame, query: str, source: str = "") -> dict[str, Any]:
    """``source`` is the filter that the search ran with."""
    shares = F.transform(F.coalesce("contributions", F.array().cast("array<struct<term:string,score:double>>")), lambda c: F.struct(c["term"].alias("term"), F.round(c["score"], 4).alias("score")))
    rows = shaped(found.orderBy("rank"), "rank", F.round("score", 4).alias("score"), "matched_terms", "highlights", shares.alias("contributions"), chunk_fields())
    return {"query": query, "source": source, "results": rows}


def usage(used) -> dict[str, Any] | None:
    if used is None:
        return None
    return {"model": used.model, "input_tokens": used.input_tokens, "output_tokens": used.output_tokens, "cache_creation_input_tokens": used.cache_created, "cache_read_input_tokens": used.cache_read_tokens}


def answer(made, source: str = "") -> dict[str, Any]:
    cost = None if made.cost_usd is None else round(made.cost_usd, 6)
    return {"question": made.question, "answer": made.text, "sources": search_results(made.passages, made.question)["results"], "source": source, "usage": usage(made.usage), "cost_usd": cost}


def stats(made: DataFrame, index_bytes: int) -> dict[str, Any]:
    return shaped(made, "documents", "chunks", "terms", "vocabulary", "top_terms")[0] | {"index_bytes": index_bytes}


def overview(tables: dict[str, DataFrame], index_bytes: int, most_points: int) -> dict[str, Any]:
    """The dashboard; of the map a sample of at most ``most_points`` chunks."""
    return stats(tables["stats"], index_bytes) | {
        "documents_by_type": shaped(tables["types"], "type", "documents"),
        "chunk_lengths": shaped(tables["lengths"].orderBy("low"), "low", "high", F.col("count").alias("chunks")),
        "relations": shaped(tables["relations"], "first", "second", "shared_terms"),
        "chunk_map": shaped(sampled(tables["map"], most_points), F.col("id").alias("chunk_id"), "source", "x", "y"),
    }


def sampled(points: DataFrame, most: int) -> DataFrame:
    """At most so many points, drawn from everywhere by a hash of their ids."""
    return points.orderBy(F.xxhash64("id"), "id").limit(most)


def documents(catalog: DataFrame) -> list[dict]:
    return shaped(catalog.orderBy("source"), "source", "chunks", "pages", "sections", "chunk_ids")


def indexing(report) -> dict[str, Any]:
    return {"documents": report.indexed, "chunks": report.chunks, "unchanged": report.unchanged, "skipped": list(report.skipped), "failed": [{"source": s, "reason": r} for s, r in report.failed]}


def removal(target: str, documents: int) -> dict[str, Any]:
    return {"path": target, "documents": documents}


def evaluation(outcomes: DataFrame, report: DataFrame, k: int) -> dict[str, Any]:
    total = report.first()
    found = F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))
    cases = shaped(outcomes.orderBy("query_id"), F.col("query_id").alias("query"), "first_hit", F.round(F.element_at("recall_curve", -1), 4).alias("recall"), F.round(found, 4).alias("reciprocal_rank"))
    curve = [round(v, 4) for v in total["mean_curve"] or []]
    return {"k": k, "queries": total["cases"], "recall": round(total["recall"] or 0.0, 4), "mrr": round(total["mrr"] or 0.0, 4), "recall_curve": curve, "cases": cases}
