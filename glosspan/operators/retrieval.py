"""Ranking: BM25, dense cosine, reciprocal rank fusion, re-ranking, scoped search.

A query is a row (query_id, query); a ranking is rows (query_id, id, score,
rank).  Any number of queries runs as one job.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosspan.functions.text import DEFAULT, Tokenizer, highlights, idf, matched_terms, tf_norm
from glosspan.operators import direct
from glosspan.operators.filters import in_scope, is_open
from glosspan.operators.index import Index, block, postings
from glosspan.session import small_batches

RRF_K, RRF_DEPTH, RERANK_DEPTH = 60, 50, 20


#: Query vectors of at most so many bytes are sent to every task; more are dealt with in blocks.
VECTOR_BYTES = 16 << 20
#: Vectors, and queries, that a task multiplies at once; pairs that it computes in double precision at once.
TILE, PAIRS = 1024, 1 << 15
#: Tasks a core that a search by many vectors is dealt to.
TASKS = 2
#: Order among equal scores: the document's number, then the chunk's place in it.
PLACE = ("seq", "position")


def query_terms(queries: DataFrame, tokenizer: Tokenizer = DEFAULT) -> DataFrame:
    """(query_id, term, times)."""
    terms = queries.select("query_id", F.explode(tokenizer.raw("query")).alias("raw")).select("query_id", F.lower("raw").alias("term"))
    return terms.where(tokenizer.keeps(F.col("term"))).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def asked(index: Index, **queries: str) -> DataFrame:
    return index.chunks.sparkSession.createDataFrame(list(queries.items()), "query_id string, query string")


def term_weights(index: Index, wanted: DataFrame) -> DataFrame:
    """(query_id, term, weight): times asked, times the inverse frequency in the whole index.

    The number of chunks a term is in comes from the saved bounds where they
    are exact, so postings are not read for it.
    """
    n, _ = index.totals()
    asked_for = wanted.select("term").distinct()
    if index.blocks is not None:
        df = index.blocks.join(asked_for, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    else:
        df = index.postings.join(asked_for, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return wanted.join(df, "term").select("query_id", "term", (F.col("times") * idf(F.lit(float(n)), F.col("df"))).alias("weight"))


def _scored(hits: DataFrame, weights: DataFrame, on: list[str], average: float) -> DataFrame:
    """The fold of each chunk's sorted contributions, so equal texts get equal sums."""
    share = F.col("weight") * tf_norm(F.col("tf"), F.col("length"), F.lit(average or 1.0))
    parts = hits.join(weights, on).select("query_id", "id", "source", *PLACE, "term", share.alias("share"))
    best = parts.groupBy("query_id", "id", "source", *PLACE).agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("minus"), "term"))).alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda s, p: s - p["minus"])
    contributions = F.transform("parts", lambda p: F.struct(p["term"].alias("term"), (-p["minus"]).alias("score")))
    return best.select("query_id", "id", "source", *PLACE, score.alias("score"), contributions.alias("contributions"))


def bm25_scores(index: Index, queries: DataFrame) -> DataFrame:
    """Every chunk with a query term: query_id, id, seq, position, score, contributions (largest first)."""
    weights = term_weights(index, query_terms(queries, index.tokenizer))
    hits = index.postings.join(weights.select("term").distinct(), "term", "left_semi")
    return _scored(hits, weights, ["term"], index.totals()[1])


#: What a sum of rounded shares may be off; a bound must be lower than the threshold by more.
SLACK = 1e-6


@dataclass
class Bounded:
    """The parts of a search by upper bounds, so that what each reads can be counted."""

    #: Postings of each query's dearest terms, which give the threshold.
    first: DataFrame
    #: (query_id, theta): no chunk below it is among the best k.
    thresholds: DataFrame
    #: Postings of blocks that may hold one of the best.
    opened: DataFrame
    #: All postings of the chunks met there, by query.
    hits: DataFrame
    scores: DataFrame

    def rows_read(self) -> int:
        return self.first.count() + self.opened.count() + self.hits.count()


def bm25_bounded_scores(index: Index, queries: DataFrame, k: int = 5) -> Bounded:
    """Scores of all chunks that can be among the best ``k`` of a query, found by upper bounds.

    A share is at most what the largest count and the least length of its block
    (or term) allow.  The k-th best share of a query's dearest term is a
    threshold that the k-th best score reaches; a block is opened only if its
    bound and those of the query's other terms reach it together.  Terms whose
    bounds together stay below it open no block: they only add to chunks found
    by the others.
    """
    average = index.totals()[1] or 1.0
    weights = term_weights(index, query_terms(queries, index.tokenizer))
    blocks = index.bounds_of(weights.select("term").distinct())
    limit = lambda: F.col("weight") * tf_norm(F.col("most_tf"), F.col("least_length"), F.lit(average))
    met = blocks.join(weights, "term").select("query_id", "term", "block", "n", "weight", limit().alias("bound"))
    terms = met.groupBy("query_id", "term", "weight").agg(F.max("bound").alias("bound"), F.sum("n").alias("df"))
    by = W.partitionBy("query_id")
    terms = terms.withColumn("place", F.row_number().over(by.orderBy(F.desc("bound"), "term"))).withColumn("total", F.sum("bound").over(by))
    terms = terms.withColumn("below", F.sum("bound").over(by.orderBy("bound", F.desc("term")).rowsBetween(W.unboundedPreceding, 0)))

    lead = terms.where("place = 1")
    first = index.postings.join(lead.select("query_id", "term", "weight"), "term").withColumn("share", F.col("weight") * tf_norm(F.col("tf"), F.col("length"), F.lit(average)))
    best = first.select("query_id", "share").withColumn("rank", F.row_number().over(by.orderBy(F.desc("share")))).where(F.col("rank") <= k)
    thresholds = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("share")).otherwise(0.0).alias("theta"))

    known = terms.join(thresholds, "query_id").withColumn("rest", F.col("total") - F.col("bound"))
    open_terms = known.where(F.col("below") >= F.col("theta") - SLACK).select("query_id", "term", "rest", "theta")
    open_blocks = met.join(open_terms, ["query_id", "term"]).where(F.col("bound") + F.col("rest") >= F.col("theta") - SLACK).select("query_id", "term", "block")
    placed = index.postings.withColumn("block", block())
    opened = placed.join(open_blocks, ["term", "block"]).select("query_id", "id", "block")
    found = opened.distinct()
    lookups = met.select("query_id", "term", "block", "weight").join(found.select("query_id", "block").distinct(), ["query_id", "block"], "left_semi")
    hits = placed.join(lookups, ["term", "block"]).join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
    scores = _scored(hits.drop("weight"), weights, ["query_id", "term"], average)
    return Bounded(first, thresholds, opened, hits, scores)


def bm25_bounded(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """:func:`bm25`, opening only blocks that can matter.

    Without stored postings the blocks are runs of chunks in a task: a query is
    opened in one only if the bounds of its terms there reach its threshold.
    """
    if index.derived:
        return bm25(index, queries, k)
    return ranked(bm25_bounded_scores(index, queries, k).scores, k)


def ranked(scores: DataFrame, k: int, *order: str) -> DataFrame:
    """The best ``k`` of each query; scores equal to nine places keep the order of the columns, by default PLACE as far as it is there."""
    by = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *(order or [c for c in PLACE if c in scores.columns]))
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def bm25(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each chunk is scored for all queries in one task (see :mod:`direct`), from stored postings or from its text."""
    return ranked(direct.best(index, query_terms(queries, index.tokenizer), k), k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` by cosine above 0 of vectors (id, seq, vector) for each query (query_id, vector).

    The queries are stated by the caller; as many as VECTOR_BYTES hold are sent
    to every task and meet each batch of vectors as one matrix product.  A task
    keeps the best ``k`` a query of all it has seen, so k rows a query and task
    are shuffled and ranked; vectors are dealt to no more tasks than keep the
    cluster busy, queries to more blocks where vectors lie in too few partitions.
    Vectors without a length, or of another number of components, have no cosine.
    """
    spark = vectors.sparkSession
    columns = [c for c in vectors.columns if c not in ("vector", "query_id", "score", "rank")]
    schema = ", ".join(["query_id string", *(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in columns), "score double"])
    small_batches(spark)
    stated = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
    count, width = stated.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    if not count:
        return ranked(spark.createDataFrame([], schema), k)
    blocks = -(-count * (8 * width + 64) // VECTOR_BYTES)
    rows = vectors.select(*columns, F.col("vector").cast("array<double>").alias("vector"))
    if count > TILE:
        tasks, dealt = TASKS * spark.sparkContext.defaultParallelism, max(1, rows.rdd.getNumPartitions())
        blocks = max(blocks, min(-(-tasks // dealt), -(-count // TILE)))
        rows = rows.coalesce(-(-tasks // blocks))
    parts = []
    for number in range(blocks):
        held = stated.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else stated
        asked_for = _matrices(held.where(F.size("q") > 0).toArrow())
        if asked_for:
            sent = spark.sparkContext.broadcast(asked_for)
            parts.append(rows.mapInArrow(_best_of(sent, columns, k), schema))
    return ranked(functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema), k)


def _matrices(queries: pa.Table) -> dict[int, tuple[list[str], np.ndarray]]:
    """Names and vectors of queries (name, vector) by width; single precision where that holds them exactly."""
    names, vectors = (queries.column(c).combine_chunks() for c in (0, 1))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    whole = np.bincount(pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)[pc.is_null(vectors.flatten()).to_numpy(zero_copy_only=False)], minlength=len(vectors)) == 0
    out = {}
    for width in np.unique(lengths[(lengths > 0) & whole]).tolist():
        at = pa.array(np.flatnonzero((lengths == width) & whole))
        matrix = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        with np.errstate(all="ignore"):
            single = matrix.astype(np.float32)
        out[width] = (names.take(at).to_pylist(), single if np.array_equal(single, matrix) else matrix)
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    """Of vectors; nan for those that have no cosine."""
    with np.errstate(all="ignore"):
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        return np.where((length > 0) & np.isfinite(length), length, np.nan)


def _unit(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """In single precision, for the product that most pairs get no further than."""
    with np.errstate(all="ignore"):
        return np.where(np.isnan(length)[:, None], 0.0, x / length[:, None]).astype(np.float32)


def _best_of(sent, columns: list[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps batches of vectors to the best ``k`` rows for each of the queries sent.

    A tile of vectors and one of queries are multiplied in single precision.
    Only pairs that come as near to the k-th best so far as that can be wrong
    are computed in double precision; they wait until they are worth putting in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value if isinstance(sent.value, dict) else _matrices(pa.table({"n": [n for n, _ in sent.value], "v": pa.array([v for _, v in sent.value], pa.list_(pa.float64()))}))
        tiles: dict[int, list[_Tile]] = {}
        for width, (names, matrix) in asked.items():
            tiles[width] = [_Tile(begin, matrix[begin : begin + TILE], k) for begin in range(0, len(names), TILE)]
        space = np.empty(TILE * TILE, np.float32)
        for batch in (whole.slice(at, TILE) for whole in batches for at in range(0, whole.num_rows, TILE)):
            lengths = pc.fill_null(pc.list_value_length(batch.column(len(columns))), 0).to_numpy(zero_copy_only=False)
            for width, held in tiles.items():
                some = batch.filter(pa.array(lengths == width))
                if not some.num_rows:
                    continue
                x = some.column(len(columns)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                length, plain = _lengths(x), pa.Table.from_batches([some.select(columns)])
                unit = _unit(x, length)
                for tile in held:
                    tile.meet(x, length, unit, plain, space)
        for width, held in tiles.items():
            for tile in held:
                table = tile.settled()
                if table is not None:
                    names = pa.array(asked[width][0], pa.string()).take(table["_q"].combine_chunks())
                    yield from pa.Table.from_arrays([names, *(table[c] for c in columns), table["score"]], ["query_id", *columns, "score"]).combine_chunks().to_batches()

    return run


def _true(found: np.ndarray) -> np.ndarray:
    """Where a few of many are true, eight looked at at once."""
    flat = found.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    word, byte = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + byte, whole + np.flatnonzero(flat[whole:])])


class _Tile:
    """Queries that a task multiplies at once, and the best ``k`` rows of each so far."""

    def __init__(self, begin: int, q: np.ndarray, k: int):
        self.begin, self.q, self.k, self.length = begin, q, k, _lengths(q.astype(np.float64))
        self.unit = np.ascontiguousarray(_unit(q.astype(np.float64), self.length).T)
        #: What a product in single precision may be off.
        self.off = (q.shape[1] + 8) * 2.0**-23
        self.best: pa.Table | None = None
        self.waiting: list[pa.Table] = []
        #: The least that a row needs of queries that have k rows.
        self.floor = np.zeros(len(q))

    def meet(self, x: np.ndarray, length: np.ndarray, unit: np.ndarray, plain: pa.Table, space: np.ndarray) -> None:
        """Take these vectors into account; ``space`` holds the product meanwhile."""
        product = np.matmul(unit, self.unit, out=space[: len(unit) * len(self.q)].reshape(len(unit), -1))
        # Near ties of the k-th stay until they are put in order.
        least = self.floor - 1e-8 - self.off
        if len(x) > self.k and 2 * np.count_nonzero(self.floor) < len(self.floor):
            least = np.maximum(least, np.partition(product, -self.k, axis=0)[-self.k] - 1e-8 - 2 * self.off)
        near = _true(product >= least.astype(np.float32) - np.float32(1e-7))
        for some in (near[i : i + PAIRS] for i in range(0, len(near), PAIRS)):
            at, of = np.divmod(some, len(self.q))
            with np.errstate(all="ignore"):
                score = np.einsum("ij,ij->i", x[at], self.q[of].astype(np.float64)) / length[at] / self.length[of]
                kept = (score > 0) & (score >= self.floor[of] - 1e-8)
            if not kept.any():
                continue
            at, of, score = at[kept], of[kept], score[kept]
            self.waiting.append(plain.take(pa.array(at)).append_column("_q", pa.array(of + self.begin)).append_column("score", pa.array(score)))
            if self.best is None or sum(t.num_rows for t in self.waiting) > 2 * self.k * len(self.q):
                self.settled()

    def settled(self) -> pa.Table | None:
        """The best so far, in order."""
        if self.waiting:
            self.best = _first(pa.concat_tables([*([] if self.best is None else [self.best]), *self.waiting]), self.k)
            self.waiting = []
            # What the k-th of a query has, once it has k, is the least that a later row needs.
            numbers, low = self.best["_q"].to_numpy() - self.begin, np.full(len(self.q), np.inf)
            np.minimum.at(low, numbers, self.best["score"].to_numpy())
            self.floor = np.where(np.bincount(numbers, minlength=len(self.q)) >= self.k, low, 0.0)
        return self.best


def _first(table: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each query, as :func:`ranked` orders them."""
    place = [c for c in PLACE if c in table.column_names]
    table = table.append_column("_minus", pa.array(-np.round(table["score"].to_numpy(), 9)))
    table = table.sort_by([(c, "ascending") for c in ("_q", "_minus", *place)])
    of = table["_q"].to_numpy()
    begins = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
    rank = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
    return table.drop_columns("_minus").filter(pa.array(rank < k)) if len(of) else table.drop_columns("_minus")


def fused(rankings: list[DataFrame], k: int = 5, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties by id. The rankings hold max(k, 50) rows a query."""
    votes = rankings[0].select("query_id", "id", "rank")
    for other in rankings[1:]:
        votes = votes.unionByName(other.select("query_id", "id", "rank"))
    scores = votes.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))).alias("score"))
    return ranked(scores, k, "id")


def reranked(candidates: DataFrame, grades: DataFrame, k: int = 5) -> DataFrame:
    """Candidates (query_id, id, rank) by grade, then first-stage rank; a missing grade is 0."""
    met = candidates.select("query_id", "id", F.col("rank").alias("first")).join(grades.select("query_id", "id", "grade"), ["query_id", "id"], "left")
    return ranked(met.select("query_id", "id", "first", F.coalesce("grade", F.lit(0)).cast("double").alias("score")), k, "first")


def parsed_grades(answers: DataFrame) -> DataFrame:
    """(query_id, passage, grade) from JSON answers (query_id, answer, count).

    The first grade of a passage counts, kept within 0 and 10; unknown passages are left out.
    """
    shape = "struct<grades:array<struct<passage:int,grade:int>>>"
    rows = answers.select("query_id", "count", F.posexplode(F.from_json("answer", shape)["grades"]).alias("at", "g"))
    rows = rows.where((F.col("g.passage") >= 1) & (F.col("g.passage") <= F.col("count")))
    first = rows.groupBy("query_id", F.col("g.passage").alias("passage")).agg(F.min_by("g.grade", "at").alias("grade"))
    return first.select("query_id", "passage", F.greatest(F.lit(0), F.least(F.lit(10), "grade")).alias("grade"))


def coverage_grades(index: Index, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The offline grader: 0 to 10 by the share of query terms that a candidate holds."""
    wanted = query_terms(queries, index.tokenizer)
    asked_for = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    if index.derived:
        terms = postings(index.chunks.join(F.broadcast(candidates.select("id").distinct()), "id", "left_semi"), index.tokenizer)
    else:
        terms = index.postings
    held = candidates.select("query_id", "id").join(terms.select("id", "term"), "id").join(wanted, ["query_id", "term"]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("held"))
    return held.join(asked_for, "query_id").select("query_id", "id", F.floor(10 * F.col("held") / F.col("asked")).cast("int").alias("grade"))


class Refused(RuntimeError):
    """A model that would not grade or answer."""


#: What a grading model is asked to return.
GRADES_SCHEMA = {"type": "object", "required": ["grades"], "properties": {"grades": {"type": "array", "items": {"type": "object", "required": ["passage", "grade"], "properties": {"passage": {"type": "integer"}, "grade": {"type": "integer", "minimum": 0, "maximum": 10}}}}}}


def model_grades(call: Callable[[str, dict], str | None]) -> Callable[[Index, DataFrame, DataFrame], DataFrame]:
    """A grader that asks a model once a query: ``call(prompt, schema)`` returns JSON, or None when it refuses.

    Only the candidates to be re-ranked are collected, a few a query.
    """

    def grade(index: Index, queries: DataFrame, candidates: DataFrame) -> DataFrame:
        rows = candidates.select("query_id", "id", "rank").join(index.chunks.select("id", "text"), "id").join(queries, "query_id").orderBy("query_id", "rank").collect()
        by_query: dict[str, list] = {}
        for row in rows:
            by_query.setdefault(row["query_id"], []).append(row)
        made, numbered = [], []
        for key, found in by_query.items():
            passages = "\n\n".join(f"[{i}]\n{row['text']}" for i, row in enumerate(found, 1))
            answer = call(f"Grade from 0 to 10 how well each passage answers the question.\n\nQuestion: {found[0]['query']}\n\n{passages}", GRADES_SCHEMA)
            if answer is None:
                raise Refused(f"no grades for {found[0]['query']!r}")
            made.append((key, answer, len(found)))
            numbered += [(key, i, row["id"]) for i, row in enumerate(found, 1)]
        spark = queries.sparkSession
        grades = parsed_grades(spark.createDataFrame(made, "query_id string, answer string, count int"))
        return grades.join(spark.createDataFrame(numbered, "query_id string, passage int, id string"), ["query_id", "passage"]).select("query_id", "id", "grade")

    return grade


#: Candidates a query up to which each task keeps its own best.
DEEP = 10_000
#: Steps of score that a ranking is cut by before its exact order matters.
BINS = 1024


def within_depth(scores: DataFrame, depth: int, condition: Column, *order: str) -> DataFrame:
    """The rows that meet a condition and are among the first ``depth`` of all rows of their query.

    A histogram of scores finds the step that the depth-th row lies in: rows of
    higher steps are within, of lower ones not, and only that one step is put in
    order.
    """
    by = order or [c for c in PLACE if c in scores.columns]
    scores = scores.withColumn("_r", F.round("score", 9))
    top = scores.groupBy("query_id").agg(F.max("_r").alias("_hi"), F.min("_r").alias("_lo"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    steps = scores.join(F.broadcast(top), "query_id").withColumn("_step", F.least(F.floor((F.col("_hi") - F.col("_r")) / span * BINS), F.lit(BINS - 1)))
    counts = steps.groupBy("query_id", "_step").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy("query_id").orderBy("_step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_ahead", ahead).where(F.col("_ahead") < depth).drop("_n")
    # At most BINS rows a query.
    near = steps.join(F.broadcast(counts.withColumn("_last", F.max("_step").over(W.partitionBy("query_id")))), ["query_id", "_step"])
    sure = near.where((F.col("_step") < F.col("_last")) & condition)
    edge = near.where(F.col("_step") == F.col("_last"))
    edge = edge.withColumn("_k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_r"), *by)) + F.col("_ahead"))
    edge = edge.where((F.col("_k") <= depth) & condition).drop("_k")
    return sure.unionByName(edge).drop("_hi", "_lo", "_r", "_step", "_ahead", "_last")


def scoped(index: Index, queries: DataFrame, pattern: str, k: int = 5, search: Callable[[Index, DataFrame, int], DataFrame] = bm25, exact: bool = False) -> DataFrame:
    """Search within a source filter, with statistics of the whole index.

    As many candidates count as the filter's selectivity asks for, so fewer than
    ``k`` may come back; with ``exact``, all in scope count.  BM25 hits are
    filtered before they are ranked, and the depth is found without ranking what
    is out of scope; another ``search`` is asked for its candidates.
    """
    if is_open(pattern):
        return search(index, queries, k)
    total = index.totals()[0]
    kept = index.sources().where(in_scope(pattern)).agg(F.sum("chunks")).first()[0] or 0
    depth = min(total, -(-k * total // kept)) if kept else 0
    if search is bm25 and (exact or depth >= total or depth <= DEEP):
        wanted = query_terms(queries, index.tokenizer)
        if not depth:
            wanted = wanted.limit(0)
        if exact or depth >= total:
            return ranked(direct.best(index, wanted, k, in_scope(pattern)), k)
        return ranked(ranked(direct.best(index, wanted, depth), depth).drop("rank").where(in_scope(pattern)), k)
    if search is bm25:
        scores = bm25_scores(index, queries)
        found = scores.where(in_scope(pattern)) if exact or depth >= total else within_depth(scores, depth, in_scope(pattern))
        return ranked(found, k)
    found = search(index, queries, total if exact else depth)
    return ranked(found.drop("rank").where(in_scope(pattern)), k)


def with_passages(found: DataFrame, index: Index, query: str, highlight: Callable[..., Column] = highlights) -> DataFrame:
    """Result rows with their chunk, the highlighted spans and the matched terms."""
    chunks = index.chunks.drop("seq", "source", "position" if "position" in found.columns else "")
    rows = chunks.join(F.broadcast(found), "id")
    rows = rows.select(*found.columns, *[c for c in chunks.columns if c not in found.columns])
    return rows.withColumn("highlights", highlight("text", index.tokenizer.terms(query), index.tokenizer)).withColumn("matched_terms", matched_terms("highlights"))


def retriever(kind: str, index: Index, vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, rerank: bool = False, grade: Callable[[Index, DataFrame, DataFrame], DataFrame] = coverage_grades, depth: int = RERANK_DEPTH) -> Callable[[DataFrame, int], DataFrame]:
    """A search by name: bm25, embedding or hybrid, re-ranked or not."""
    searches = {
        "bm25": lambda q, k: bm25(index, q, k),
        "embedding": lambda q, k: dense(vectors, embed(q), k),
        "hybrid": lambda q, k: fused([bm25(index, q, max(k, RRF_DEPTH)), dense(vectors, embed(q), max(k, RRF_DEPTH))], k),
    }
    if kind not in searches:
        raise ValueError(f"retriever must be one of {', '.join(searches)}")
    search = searches[kind]
    if not rerank:
        return search

    def regraded(queries: DataFrame, k: int) -> DataFrame:
        first = search(queries, max(k, depth))
        return reranked(first, grade(index, queries, first), k)

    return regraded

