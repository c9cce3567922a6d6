"""Connected components of a link table by alternating large-star and small-star steps.

A component of a billion nodes ends as one star, so its centre is a hot key.
Centres with more than HOT links are few (with more links the bound rises, so
that there are 2**20 at most); what their links need to know of them is
broadcast, and only the other links are dealt out by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspan.llm.common import discard, staged

HOT = 1 << 12


def _starred(edges: DataFrame, larger: bool, hot: int | None) -> DataFrame:
    """One step: each node's (larger or not larger) neighbours are tied to the least node around it."""
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    if hot is None:
        tied = around.join(least.drop("n"), "u")
    else:
        least = staged(least, "least")
        few = F.broadcast(least.where(F.col("n") > hot).select("u", "m"))
        rest = around.join(few.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hot).select("u", "m").hint("merge"), "u")
        tied = around.join(few, "u").unionByName(rest)
    if larger:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node in ``links`` (u, v); label is the least node of its component."""
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        centres = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
        total, most, *now = centres.agg(F.sum("n"), F.max("n"), F.sum("h"), F.count(F.lit(1))).first()
        if now == mark or not total:
            break
        bound = max(HOT, total >> 20)
        hot = bound if most > bound else None
        mark, old = now, edges
        edges = staged(_starred(staged(_starred(edges, True, hot), "half") if hot else _starred(edges, True, hot), False, hot), "edges")
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
