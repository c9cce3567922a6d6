"""Centroid clustering by Lloyd's rounds over two trees.

Vectors become integers (floor of 1024 times each component), so distances and
means are exact and no order of rows or partitions can change a result.  They
are packed once into blocks of BLOCK vectors, and each block gets a cover tree:
a node's point is one of its vectors, all its vectors lie within its radius, and
its children's points lie more than half that radius apart.  Blocks and trees
are written once and read by every round.

A round sends the centroids and a cover tree over them (k times d numbers) to
all tasks.  In a block, pairs of a vector node and a centroid node are followed
down both trees: a pair goes when its least possible distance is above the
greatest distance that some other centroid can have from the vector node; a
vector node with one centroid left belongs to it as a whole, by its stored
sums; pairs of leaves are compared exactly, in integers.  Bounds have a margin
for rounding and a pair goes only if it is strictly worse, so ties are always
settled exactly, for the smaller number.  A task returns one count and one sum
a centroid and component, whatever it holds.

Defined results: vectors of another length, null vectors and vectors with a
null or non-finite component are left out, as are those with a component beyond
LARGEST in absolute value, whose distances would not fit 64 bits; equal vectors
(any number of them) are one leaf; repeated ids are vectors of their own, a null
id is hashed as no characters; with fewer vectors than k there are as many
centroids as vectors; an empty table gives an empty result; columns other than
vec_id and embedding, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.common import staged, table

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
#: Vectors of a block, and of a leaf unless its vectors are equal.
BLOCK, LEAF = 1024, 12
LARGEST = float((1 << 27) // SCALE)
#: Distances of doubles are off by less than this part of the largest coordinate's.
MARGIN = 1e-9
#: Exact comparisons made at a time.
AT_ONCE = 1 << 15
TREE = ("point", "begin", "end", "child", "children")
STORED = "vec_id array<long>, x binary, " + ", ".join(f"{name} array<int>" for name in TREE) + ", radius array<double>"


class Tree(NamedTuple):
    """Nodes in breadth-first order; a node's vectors are begin..end, its children child..child+children."""

    point: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    step = x - y
    return np.einsum("ij,ij->i", step, step)


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """(order, tree) of the rows of ``x``: with the rows in that order, every node's are contiguous.

    A node's children are chosen greedily: the node's own point first, then
    always the vector farthest from all points chosen, each taking those within
    half the node's radius that none before it took.
    """
    order = np.arange(len(x))
    nodes: list[list] = []
    if len(x):
        nodes.append([0, 0, len(x), 0, 0, 0.0])
    far = [np.sqrt(apart(x, x[:1]).astype(np.float64))] if len(x) else []
    i = 0
    while i < len(nodes):
        _, begin, end, *_ = nodes[i]
        held, dist = order[begin:end], far[i]
        far[i] = None
        radius = float(dist.max())
        nodes[i][5] = radius * (1 + MARGIN)
        if radius > 0 and end - begin > leaf:
            rest, nearest, parts = np.arange(len(held)), dist.copy(), []
            # The node's point is the first of its vectors.
            point, own = 0, dist
            while True:
                near = own[rest] <= radius / 2
                parts.append((rest[near], own[rest[near]], point))
                rest = rest[~near]
                if not len(rest):
                    break
                point = int(rest[np.argmax(nearest[rest])])
                own = np.full(len(held), np.inf)
                own[rest] = np.sqrt(apart(x[held[rest]], x[held[point]]).astype(np.float64))
                nearest[rest] = np.minimum(nearest[rest], own[rest])
            nodes[i][3:5] = [len(nodes), len(parts)]
            at, moved = begin, []
            for members, dists, centre in parts:
                lead = np.argsort(members != centre, kind="stable")
                moved.append(held[members[lead]])
                nodes.append([at, at, at + len(members), 0, 0, 0.0])
                far.append(dists[lead])
                at += len(members)
            order[begin:end] = np.concatenate(moved)
        i += 1
    columns = list(zip(*nodes, strict=True)) or [()] * 6
    return order, Tree(*(np.array(c, np.float64 if k == 5 else np.int64) for k, c in enumerate(columns)))


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for sizes[i] numbers, one i after another."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def nearest(tree: Tree, x: np.ndarray, over: Tree, c: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of the nearest centroid of every row, exact comparisons made): both trees followed down together.

    ``x`` and ``c`` are in their trees' orders; ``number`` names the rows of
    ``c``.
    """
    owner, compared = np.empty(len(x), np.int64), 0
    single = (over.children == 0) & (over.radius == 0)
    # Of equal centroids the smallest number stands for all.
    lowest = np.array([number[b:e].min() for b, e in zip(over.begin, over.end, strict=True)])
    v, w = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        d = np.sqrt(apart(x[tree.point[v]], c[over.point[w]]).astype(np.float64))
        # A centroid node's point is a centroid, so no vector of v is farther from its nearest than this.
        most = np.full(len(tree.point), np.inf)
        np.minimum.at(most, v, d + tree.radius[v])
        least = d - tree.radius[v] - over.radius[w]
        left = least <= most[v] + MARGIN * (d + most[v])
        v, w = v[left], w[left]
        partners = np.bincount(v, minlength=len(tree.point))
        unsettled = np.bincount(v, ~single[w], minlength=len(tree.point)) > 0
        alone = (partners[v] == 1) & ~unsettled[v]
        for node, centre in zip(v[alone].tolist(), w[alone].tolist(), strict=True):
            owner[tree.begin[node] : tree.end[node]] = lowest[centre]
        exact = ~alone & (tree.children[v] == 0) & ~unsettled[v]
        compared += _compare(tree, x, over, c, lowest, v[exact], w[exact], owner)
        v, w = v[~alone & ~exact], w[~alone & ~exact]
        # Each side is replaced by its children where it has any.
        sizes = np.maximum(tree.children[v], 1)
        first = np.where(tree.children[v] > 0, tree.child[v], v)
        v, w = _spread(first, sizes), np.repeat(w, sizes)
        sizes = np.maximum(over.children[w], 1)
        first = np.where(over.children[w] > 0, over.child[w], w)
        v, w = np.repeat(v, sizes), _spread(first, sizes)
    return owner, compared


def _compare(tree: Tree, x: np.ndarray, over: Tree, c: np.ndarray, lowest: np.ndarray, v: np.ndarray, w: np.ndarray, owner: np.ndarray) -> int:
    """Settle leaves against the centroids left to them; of equal vectors one is compared for all."""
    by = np.argsort(v, kind="stable")
    v, w = v[by], w[by]
    sizes = np.where(tree.radius[v] > 0, tree.end[v] - tree.begin[v], 1)
    done = 0
    while len(v):
        upto = max(1, int(np.searchsorted(np.cumsum(sizes), AT_ONCE, "right")))
        upto = int(np.searchsorted(v, v[upto - 1], "right"))
        at, of = _spread(tree.begin[v[:upto]], sizes[:upto]), np.repeat(w[:upto], sizes[:upto])
        d = apart(x[at], c[over.point[of]])
        best = np.lexsort((lowest[of], d, at))
        first = best[np.concatenate([[True], np.diff(at[best]) > 0])]
        owner[at[first]] = lowest[of[first]]
        for node in np.unique(v[:upto][tree.radius[v[:upto]] == 0]).tolist():
            owner[tree.begin[node] : tree.end[node]] = owner[tree.begin[node]]
        done += len(at)
        v, w, sizes = v[upto:], w[upto:], sizes[upto:]
    return done


def _integers(values: np.ndarray, dimensions: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64).reshape(-1, dimensions)


def _usable(column: Column, dimensions: int) -> Column:
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < LARGEST))
    return (F.size(column) == dimensions) & fine


def blocks(vectors: DataFrame, dimensions: int = DIMENSIONS, block: int = BLOCK) -> DataFrame:
    """The usable vectors as persisted blocks with their trees."""

    def packed(ids: list, x: np.ndarray) -> pa.RecordBatch:
        order, tree = cover_tree(x)
        columns = [[ids[i] for i in order], x[order].astype("<i4").tobytes(), *(getattr(tree, name) for name in TREE), tree.radius]
        types = [pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int32())] * len(TREE), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], ["vec_id", "x", *TREE, "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = [], np.empty((0, dimensions), np.int64)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            x = np.concatenate([x, _integers(batch.column(1).flatten().to_numpy(), dimensions)])
            while len(ids) >= block:
                yield packed(ids[:block], x[:block])
                ids, x = ids[block:], x[block:]
        if ids:
            yield packed(ids, x)

    kept = vectors.where(_usable(F.col("embedding"), dimensions)).select(F.col("vec_id").cast("long"), "embedding")
    return staged(kept.mapInArrow(run, STORED), "vector-blocks")


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The usable vectors with the k smallest hashes of their ids, in that order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    kept = vectors.where(_usable(F.col("embedding"), dimensions)).select(F.sha2(named, 256).alias("h"), "embedding")
    rows = kept.orderBy("h", "embedding").limit(k).collect()
    return _integers(np.array([r["embedding"] for r in rows], np.float64), dimensions)


def _block(row: dict, dimensions: int) -> tuple[list, np.ndarray, Tree]:
    x = np.frombuffer(row["x"], "<i4").reshape(-1, dimensions).astype(np.int64)
    return row["vec_id"], x, Tree(*(np.array(row[name], np.int64) for name in TREE), np.array(row["radius"], np.float64))


def _sums(centroids: np.ndarray):
    """A task's counts and component sums: rows (cluster, dim, total), with dim -1 for the count."""
    k, dimensions = centroids.shape
    number, over = cover_tree(centroids, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, x, tree = _block(row, dimensions)
                owner, _ = nearest(tree, x, over, centroids[number], number)
                # Runs of one owner add up as differences of running sums.
                ahead = np.concatenate([np.zeros((1, dimensions), np.int64), np.cumsum(x, 0)])
                ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
                begins = np.append(0, ends[:-1])
                np.add.at(totals[:, 1:], owner[begins], ahead[ends] - ahead[begins])
                np.add.at(totals[:, 0], owner[begins], ends - begins)
        cluster, dim = np.divmod(np.arange(totals.size), dimensions + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim - 1, pa.int32()), pa.array(totals.ravel())], ["cluster", "dim", "total"])

    return run


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid that has vectors becomes the floor of their mean."""
    rows = stored.mapInArrow(_sums(centroids), "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"))
    totals = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for row in rows.collect():
        totals[row["cluster"], row["dim"] + 1] = row["total"]
    count = totals[:, :1]
    return np.where(count > 0, totals[:, 1:] // np.maximum(count, 1), centroids)


def assigned(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of every stored vector."""
    dimensions = centroids.shape[1]
    number, over = cover_tree(centroids, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x, tree = _block(row, dimensions)
                owner, _ = nearest(tree, x, over, centroids[number], number)
                columns = [pa.array(ids, pa.int64()), pa.array(owner, pa.int32()), pa.array(apart(x, centroids[owner]))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rounds end early when no centroid moves: the rest would change nothing.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, dimensions, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    stored = blocks(vectors, dimensions)
    for _ in range(rounds):
        after = moved(stored, centroids)
        if (after == centroids).all():
            break
        centroids = after
    rows = staged(assigned(stored, centroids), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(i, inertia[i], sum(inertia.values()), named[i]) for i in inertia]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings``."""
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The rounds one after another, each as an assignment and its means."""
    parts = [rf"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS k, x AS c FROM (
    SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
p{i} AS (SELECT rn, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT rn, k, d FROM p{i} QUALIFY row_number() OVER (PARTITION BY rn ORDER BY d, k) = 1)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (
  SELECT k, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT k, i, sum(e)::DOUBLE AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, unnest(range(len(x))) AS i FROM a{i} JOIN v USING (rn)) GROUP BY k, i) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    return ",".join(parts) + f"""
SELECT vec_id, k AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rn) JOIN c{rounds} USING (k)
"""


QUERIES = {"op13_clustering": op13_clustering}
ORACLES = {"op13_clustering": oracle()}
