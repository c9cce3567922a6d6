"""Retrieval quality: outcomes of labelled queries, recall and reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspan.functions.text import source_matches, words
from glosspan.session import small_batches


def outcomes(ranking: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """query_id, first_hit (rank or null) and recall_curve (array of k).

    ``ranking``: query_id, source, rank.  ``cases``: query_id, relevant
    (array).  A label counts once, at the first rank whose source matches it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    labels = cases.select("query_id", F.explode(F.array_distinct("relevant")).alias("label"))
    near = ranking.where(F.col("rank") <= k).select("query_id", "source", "rank")
    met = labels.join(near, "query_id").where(source_matches("source", "label")).groupBy("query_id", "label").agg(F.min("rank").alias("rank"))
    found = met.groupBy("query_id").agg(F.min("rank").alias("first_hit"), F.collect_list("rank").alias("ranks"))
    total = cases.select("query_id", F.size(F.array_distinct("relevant")).alias("labels"))
    at = lambda cut: F.size(F.filter(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: r <= cut)) / F.col("labels")
    return total.join(found, "query_id", "left").select("query_id", "first_hit", F.transform(F.sequence(F.lit(1), F.lit(k)), at).alias("recall_curve"))


def report(done: DataFrame, k: int = 5) -> DataFrame:
    """One row: cases, recall (at k), mrr, mean_curve; zeros without cases."""
    curve = F.array(*[F.coalesce(F.avg(F.element_at("recall_curve", i + 1)), F.lit(0.0)) for i in range(k)])
    return done.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.avg(F.element_at("recall_curve", k)), F.lit(0.0)).alias("recall"), F.coalesce(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), F.lit(0.0)).alias("mrr"), curve.alias("mean_curve"))


#: Words by which a passage is looked up before it is compared whole.
KEY = 8


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, relevant): the sources of the documents that hold a passage's words in order.

    The passages are stated by the caller and sent to every task.  Where one of
    their first words stands in a document, its next words (KEY of them, or all)
    are looked up; only what meets is compared whole.  Documents are read once,
    and what is shuffled is their names.
    """
    small_batches(docs.sparkSession)
    asked = [(r["query_id"], r["ws"]) for r in passages.select("query_id", words("text").alias("ws")).where(F.size("ws") > 0).collect()]
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key: dict[tuple[str, ...], list[tuple[str, list[str]]]] = {}
        for query, ws in sent.value:
            by_key.setdefault(tuple(ws[:KEY]), []).append((query, ws))
        sizes, first = sorted({len(key) for key in by_key}), pa.array(sorted({key[0] for key in by_key}), pa.string())
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            at = np.flatnonzero(pc.is_in(flat, value_set=first).to_numpy(zero_copy_only=False))
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[at]
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            found = set()
            for i, r in zip(at.tolist(), row.tolist(), strict=True):
                ahead = tuple(flat.slice(i, min(KEY, int(ends[r]) - i)).to_pylist())
                for n in sizes:
                    for query, ws in by_key.get(ahead[:n], ()) if n <= len(ahead) else ():
                        if i + len(ws) <= ends[r] and flat.slice(i, len(ws)).to_pylist() == ws:
                            found.add((query, r))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in pairs], pa.string()), batch.column(0).take(pa.array([r for _, r in pairs], pa.int64()))], ["query_id", "source"])

    met = docs.select("source", words("text").alias("ws")).mapInArrow(run, "query_id string, source string")
    return met.groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("relevant"))
