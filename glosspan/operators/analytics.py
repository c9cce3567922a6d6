"""What an index holds: counts, terms, relations, histogram, catalog, map."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosspan.functions.text import descriptive, file_type, word_count
from glosspan.operators.index import Index
from glosspan.operators.terms import lists, sent
from glosspan.session import small_batches, shared_dir


def term_counts(index: Index) -> DataFrame:
    """(term, count): how often each term occurs in all chunks.

    Without stored postings a task counts terms batch by batch, without their
    chunks, so a row for each term and batch leaves it at most.
    """
    if not index.derived:
        return index.postings.groupBy("term").agg(F.sum("tf").alias("count"))
    small_batches(index.chunks.sparkSession)
    stop = index.tokenizer.stopwords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = pa.chunked_array([found.flatten() for found in lists(batch.column(0), stop)], pa.string())
            yield pa.RecordBatch.from_struct_array(met.value_counts()).rename_columns(["term", "tf"])

    rows = index.chunks.select(sent(index.tokenizer).alias("terms")).mapInArrow(run, "term string, tf long")
    return rows.groupBy("term").agg(F.sum("tf").alias("count"))


def top_terms(index: Index, k: int = 10) -> DataFrame:
    return term_counts(index).orderBy(F.desc("count"), "term").limit(k)


def stats(index: Index, k: int = 10) -> DataFrame:
    """One row: documents, chunks, terms, vocabulary, top_terms."""
    by_source = index.chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    counts = by_source.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    by_term = term_counts(index).withColumnRenamed("count", "n")
    terms = by_term.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count(F.lit(1)).alias("vocabulary"))
    top = by_term.withColumnRenamed("n", "count").orderBy(F.desc("count"), "term").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("minus"), "term"))).alias("t"))
    top = top.select(F.transform("t", lambda t: F.struct(t["term"].alias("term"), (-t["minus"]).alias("count"))).alias("top_terms"))
    return counts.crossJoin(terms).crossJoin(top)  # three rows of totals


#: Terms whose number of documents is sent to every task.
COMMON = 1 << 17


def document_terms(index: Index, k: int = 10) -> DataFrame:
    """Characteristic terms of each document: source, rank, term, weight = tf ln((1 + D) / df).

    A document's counts are one row, shuffled once and kept.  The df of the
    COMMON commonest terms are sent to every task; any other term has one
    between 1 and the least of those, so its weight has bounds.  Only terms
    whose weight may be among the document's best ``k`` leave the task, and of
    these only the others are joined with their df.
    """
    spark = index.chunks.sparkSession
    small_batches(spark)
    home = f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}"
    if index.derived:
        stop = index.tokenizer.stopwords
        rows = index.chunks.select("source", sent(index.tokenizer).alias("terms")).mapInArrow(lambda batches: _by_source(batches, stop), "source string, terms array<string>, tfs array<long>")
        rows = rows.groupBy("source").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("tfs")).alias("tfs"))
    else:
        rows = index.postings.groupBy("source").agg(F.collect_list(F.struct("term", "tf")).alias("met"))
        rows = rows.select("source", F.transform("met", lambda m: m["term"]).alias("terms"), F.transform("met", lambda m: m["tf"]).alias("tfs"))
    rows.write.parquet(f"{home}/documents")
    counts = spark.read.parquet(f"{home}/documents")
    counts.select("terms", "tfs").mapInArrow(_met_in, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).where(descriptive("term")).write.parquet(f"{home}/df")
    df = spark.read.parquet(f"{home}/df")
    # Chunks without terms leave a row, postings none.
    documents = counts.count() if index.derived else index.chunks.select("source").distinct().count()
    common = df.orderBy(F.desc("df"), "term").limit(COMMON).toArrow()
    rest = common.num_rows == COMMON
    most = min(common["df"].to_pylist()) if rest else 1
    known = spark.sparkContext.broadcast((common["term"].to_pylist(), common["df"].to_pylist()))
    maybe = counts.mapInArrow(_candidates(known, documents, rest, most, k), "source string, term string, tf long, df long")
    found = maybe.where("df IS NOT NULL")
    if rest:
        found = found.unionByName(maybe.where("df IS NULL").drop("df").join(df, "term"))
    weighed = found.withColumn("weight", F.col("tf") * F.log(F.lit(1.0 + documents) / F.col("df")))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc(F.round("weight", 9)), "term"))
    return weighed.withColumn("rank", rank).where(F.col("rank") <= k).select("source", "rank", "term", "weight")


def _summed(lists: pa.Array, counts: pa.Array | None, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, tf, dictionary) of lists of terms, put together by row, in that order."""
    terms = lists.flatten().dictionary_encode()
    kinds = max(1, len(terms.dictionary))
    of = row[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)].astype(np.int64)
    keys, at = np.unique(of * kinds + terms.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    tf = np.bincount(at, None if counts is None else counts.flatten().to_numpy(zero_copy_only=False), len(keys)).astype(np.int64)
    return keys // kinds, keys % kinds, tf, terms.dictionary


def _by_source(batches: Iterator[pa.RecordBatch], stop: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of terms of chunks (source, terms), for each run of chunks of one source."""
    for batch in batches:
        at = 0
        for found in lists(batch.column(1), stop):
            source, at = batch.column(0).slice(at, len(found)), at + len(found)
            ends = pc.run_end_encode(source)
            stops = ends.run_ends.to_numpy(zero_copy_only=False)
            row, code, tf, names = _summed(found, None, np.searchsorted(stops, np.arange(len(found)), "right"))
            begins = pa.array(np.searchsorted(row, np.arange(len(stops) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ends.values, pa.ListArray.from_arrays(begins, names.take(pa.array(code))), pa.ListArray.from_arrays(begins, pa.array(tf))], ["source", "terms", "tfs"])


def _met_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of documents that each term of a batch is in."""
    for batch in batches:
        _, code, _, names = _summed(batch.column(0), None, np.arange(batch.num_rows))
        yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(code, minlength=len(names)))], ["term", "n"])


def _candidates(known, documents: int, rest: bool, most: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Maps documents (source, terms, tfs) to their terms that may be among the best ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df = pa.array(known.value[0], pa.string()), np.array([*known.value[1], 0], np.int64)
        for batch in batches:
            row, code, tf, names = _summed(batch.column(1), batch.column(2), np.arange(batch.num_rows))
            here = df[pc.fill_null(pc.index_in(names, value_set=terms), len(terms)).to_numpy(zero_copy_only=False)]
            kept = pc.greater_equal(pc.utf8_length(names), 3).to_numpy(zero_copy_only=False) & ~pc.match_substring_regex(names, r"^\p{Nd}+$").to_numpy(zero_copy_only=False)
            # Where all terms are sent, one that was not is none that counts.
            kept &= (here > 0) | rest
            some = kept[code]
            row, code, tf = row[some], code[some], tf[some]
            n = here[code]
            low, high = tf * np.log((1.0 + documents) / np.where(n > 0, n, most)), tf * np.log((1.0 + documents) / np.where(n > 0, n, 1))
            order = np.lexsort((-low, row))
            begins = np.searchsorted(row, np.arange(batch.num_rows))
            size = np.diff(np.append(begins, len(row)))
            # The k-th greatest lower bound of each document.
            least = np.full(batch.num_rows, -np.inf)
            full = np.flatnonzero(size >= k)
            least[full] = low[order[begins[full] + k - 1]]
            at = high >= least[row] - 1e-6
            row, code, n = row[at], code[at], n[at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(code)), pa.array(tf[at]), pa.array(n, mask=n == 0)], ["source", "term", "tf", "df"])

    return run


def relations(index: Index, k: int = 10, most: int | None = 30) -> DataFrame:
    """Pairs of documents that share characteristic terms: first, second, strength, shared_terms.

    Documents with equal term lists (copies, above all) are one class.  The
    ``most`` strongest pairs come from a join that goes down from the greatest
    strength: classes that share s terms share one of the len - s + 1 rarest of
    each, so only those are joined, and the search ends at the strength of the
    last pair that is still asked for.  Of a class only as many documents are
    spelled out as the ``most`` first pairs can name.
    """
    terms = document_terms(index, k).groupBy("source").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    if most is None:
        classes = terms.groupBy("terms").agg(F.array_sort(F.collect_list("source")).alias("sources"))
        return _spelled(_paired(classes, 1), _inside(classes))
    # Pairs are ordered by (strength, first, second): a document beyond place most + 1 of its class comes after that many others.
    place = F.row_number().over(W.partitionBy("terms").orderBy("source"))
    classes = terms.withColumn("place", place).where(F.col("place") <= most + 1).groupBy("terms").agg(F.array_sort(F.collect_list("source")).alias("sources")).persist()
    try:
        found = _inside(classes)
        strongest = lambda rows: rows.orderBy(F.desc("strength"), "first", "second").limit(most)
        best = found.sparkSession.createDataFrame([], "first string, second string, strength int, shared_terms array<string>")
        # All pairs of a strength or more are found at once, so the way down may skip.
        for strength in (*(s for s in (k, k // 2, k // 4) if s > 1), 1):
            best = strongest(_spelled(_paired(classes, strength), found))
            held = best.agg(F.count(F.lit(1)), F.min("strength")).first()
            if held[0] == most and held[1] >= strength:
                break
        # At most ``most`` rows: they outlive the classes.
        return strongest(found.sparkSession.createDataFrame(best.collect(), best.schema))
    finally:
        classes.unpersist()


def _inside(classes: DataFrame) -> DataFrame:
    """Pairs of documents of one class."""
    rows = classes.where(F.size("sources") > 1).select("terms", F.posexplode("sources").alias("at", "first"), "sources")
    rows = rows.select("first", F.explode(F.slice("sources", F.col("at") + 2, F.size("sources"))).alias("second"), "terms")
    return rows.select("first", "second", F.size("terms").alias("strength"), F.col("terms").alias("shared_terms"))


def _paired(classes: DataFrame, strength: int) -> DataFrame:
    """Pairs of classes that share ``strength`` terms or more: of_x, of_y, shared_terms.

    A pair is made once, by the first of the prefix terms it shares.
    """
    numbered = classes.select(F.xxhash64("terms").alias("class"), "terms", "sources")
    df = numbered.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = numbered.where(F.size("terms") >= strength).select("class", F.explode("terms").alias("term")).join(df, "term")
    ordered = ranked.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("by"))
    prefix = ordered.select("class", F.slice("by", 1, F.size("by") - (strength - 1)).alias("prefix"))
    listed = numbered.join(prefix, "class").select("class", "terms", "sources", "prefix", F.explode("prefix").alias("p"))
    # A term that only one class has in its prefix makes no pair.
    a, b = (listed.where("p.df > 1").select(F.col("class").alias(f"class_{c}"), F.col("terms").alias(f"terms_{c}"), F.col("sources").alias(f"of_{c}"), F.col("prefix").alias(f"prefix_{c}"), "p") for c in "xy")
    met = a.join(b, "p").where("class_x < class_y")
    met = met.where(F.element_at(F.array_sort(F.array_intersect("prefix_x", "prefix_y")), 1) == F.col("p"))
    met = met.withColumn("shared_terms", F.array_sort(F.array_intersect("terms_x", "terms_y")))
    return met.where(F.size("shared_terms") >= strength).select("of_x", "of_y", "shared_terms")


def _spelled(pairs: DataFrame, inside: DataFrame) -> DataFrame:
    """Pairs of documents: those of two classes, and those inside one."""
    rows = pairs.select("shared_terms", F.explode("of_x").alias("p"), "of_y").select("shared_terms", "p", F.explode("of_y").alias("q"))
    return rows.select(F.least("p", "q").alias("first"), F.greatest("p", "q").alias("second"), F.size("shared_terms").alias("strength"), "shared_terms").unionByName(inside)


def documents_by_type(index: Index) -> DataFrame:
    sources = index.chunks.select("source").distinct()
    return sources.groupBy(file_type("source").alias("type")).agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "type")


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """low, high (inclusive), count of equal-width integer bins; empty bins stay."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    edge = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where(F.col("lo").isNotNull())
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(bins))).cast("long")
    grid = edge.withColumn("width", width).withColumn("low", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"), "width")))
    # Values are counted before the join, so it only meets distinct values.
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("met"))
    in_bin = (F.col("value") >= F.col("low")) & (F.col("value") < F.col("low") + F.col("width"))
    met = grid.join(counts, in_bin, "left").groupBy("low", "hi", "width").agg(F.coalesce(F.sum("met"), F.lit(0)).alias("count"))
    return met.select("low", F.least(F.col("low") + F.col("width") - 1, F.col("hi").cast("long")).alias("high"), "count").orderBy("low")


def chunk_histogram(index: Index, bins: int = 10) -> DataFrame:
    return histogram(index.chunks.select(word_count("text").cast("long").alias("length")), "length", bins)


def recent_documents(index: Index, most: int = 10) -> DataFrame:
    out = index.chunks.groupBy("source").agg(F.max("indexed_at").alias("indexed_at"), F.count(F.lit(1)).alias("chunks"))
    return out.orderBy(F.desc("indexed_at"), "source").limit(most)


def catalog(index: Index) -> DataFrame:
    """Per source: ordered chunk ids, number of pages, sections in reading order."""
    rows = index.chunks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("position", "id", "section"))).alias("all"), F.max("last_page").alias("pages"))
    ids = F.transform("all", lambda c: c["id"])
    sections = F.array_distinct(F.filter(F.transform("all", lambda c: c["section"]), lambda s: F.coalesce(s, F.lit("")) != ""))
    return rows.select("source", F.size("all").alias("chunks"), ids.alias("chunk_ids"), "pages", sections.alias("sections"))


def chunks_of(index: Index, source: str) -> DataFrame:
    return index.chunks.where(F.col("source") == source).orderBy("position")


def chunk(index: Index, chunk_id: str) -> DataFrame:
    return index.chunks.where(F.col("id") == chunk_id)


def pca_map(vectors: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(key, x, y): the first two principal axes, each scaled by its largest value into -1..1.

    Sums and products are aggregated in Spark per partition (a matrix of
    dim x dim each); the driver solves that small matrix.  Of an axis, the
    loading of largest size is positive.
    """
    import pandas as pd

    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("v"))
    dim = len((rows.select("v").first() or [[]])[0])

    def moments(frames):
        n, total, outer = 0, np.zeros(dim), np.zeros((dim, dim))
        for frame in frames:
            m = np.array(frame["v"].tolist()).reshape(-1, dim)
            n, total, outer = n + len(m), total + m.sum(axis=0), outer + m.T @ m
        yield pd.DataFrame({"n": [n], "total": [total.tolist()], "outer": [outer.ravel().tolist()]})

    n, total, outer = 0, np.zeros(dim), np.zeros((dim, dim))
    for part in rows.select("v").mapInPandas(moments, "n long, total array<double>, outer array<double>").toLocalIterator():
        n, total, outer = n + part["n"], total + np.array(part["total"]), outer + np.array(part["outer"]).reshape(dim, dim)
    mean = total / max(1, n)
    axes = np.zeros((2, dim))
    if n:
        values, found = np.linalg.eigh(outer / n - np.outer(mean, mean))
        for i in range(min(2, dim)):
            if values[-1 - i] > 1e-12:
                axis = found[:, -1 - i]
                axes[i] = axis * np.sign(axis[np.argmax(np.abs(axis))])
    base = axes @ mean
    project = lambda i: F.aggregate(F.zip_with("v", F.array(*map(F.lit, axes[i].tolist())), lambda a, b: a * b), F.lit(float(-base[i])), lambda s, x: s + x)
    points = rows.select(key, project(0).alias("x"), project(1).alias("y"))
    top = points.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first() if n else (0, 0)
    scaled = [(F.col(c) / float(m) if m and m > 1e-12 else F.lit(0.0)).alias(c) for c, m in zip("xy", top, strict=True)]
    return points.select(key, *scaled)


def overview(index: Index, terms: int = 15, bins: int = 10, recent: int = 10) -> dict[str, DataFrame]:
    """The dashboard's tables."""
    return {"stats": stats(index, terms), "types": documents_by_type(index), "lengths": chunk_histogram(index, bins), "relations": relations(index), "recent": recent_documents(index, recent)}
