"""The registered queries: each operator applied to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.functions import text as T
from glosspan.operators import analytics, answers, chunking, evaluation, passages, retrieval, vectors
from glosspan.operators.filters import changed_only, ignored, in_scope, under_path, under_url
from glosspan.operators.index import Index, chunked
from glosspan.operators.segments import Segments
from glosspan.render.text import edge_label, labels
from glosspan.session import shared_dir
from glosspan.sources import html, tables
from glosspan.sql import register
from glosspan.streaming import conversations, watch

QUERY = "the eronly thonan inti of heand queeau"
STAMP = "2026-01-01T00:00:00+00:00"


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def joined(column: str | Column, by: str = ",") -> Column:
    return F.array_join(column, by)


def index(spark: SparkSession, sf: str) -> Index:
    """The index of all documents, windows of 200 words; stamps alternate by document."""
    base = Index.of(tables.documents(spark, sf))
    stamp = F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("2026-01-"), F.lpad((1 + F.col("seq") % 28).cast("string"), 2, "0"), F.lit("T00:00:00+00:00")))
    return Index(base.chunks.withColumn("indexed_at", stamp))


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """All benchmark items as queries, with all their words."""
    rows = tables.read(spark, sf, "benchmark")
    return rows.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def asked(spark: SparkSession, query: str = QUERY) -> DataFrame:
    return spark.createDataFrame([("q", query)], "query_id string, query string")


def chunk_window(spark, sf):
    rows = Index.of(tables.documents(spark, sf)).chunks
    return rows.select("id", "source", "position", "text", "content_hash", T.citation().alias("citation"))


def tokens_stats(spark, sf):
    idx = index(spark, sf)
    by_chunk = idx.postings.groupBy("id").agg(F.first("length").alias("n"), F.count(F.lit(1)).alias("d"))
    return by_chunk.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("tokens"), F.sum("d").alias("distinct_tokens"), F.max("n").alias("longest"))


def top_terms(spark, sf):
    return analytics.top_terms(index(spark, sf), 50)


def index_stats(spark, sf):
    rows = analytics.stats(index(spark, sf), 10)
    top = joined(F.transform("top_terms", lambda t: F.concat(t["term"], F.lit(":"), t["count"])))
    return rows.select("documents", "chunks", "terms", "vocabulary", top.alias("top_terms"))


def bm25_search(spark, sf):
    idx = index(spark, sf)
    found = retrieval.with_passages(retrieval.bm25(idx, asked(spark), 10), idx, QUERY)
    return found.select("rank", "id", "source", r6("score").alias("score"), joined("matched_terms").alias("matched_terms"))


def bm25_batch(spark, sf):
    """Every benchmark item as a query, top 5 each, in one job."""
    return retrieval.bm25(index(spark, sf), benchmark_queries(spark, sf), 5).select("query_id", "rank", "id", r6("score").alias("score"))


def bm25_bounded(spark, sf):
    """The same as bm25_batch, opening only blocks of postings whose bounds reach the threshold."""
    return retrieval.bm25_bounded(index(spark, sf), benchmark_queries(spark, sf), 5).select("query_id", "rank", "id", r6("score").alias("score"))


def segmented_search(spark, sf):
    """bm25_batch over an index that came about in three batches, one of which replaced half of the documents and one removed strangers."""
    store = Segments(spark, f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}")
    docs = tables.documents(spark, sf)
    odd = F.col("seq") % 2 == 1
    none = docs.limit(0).select("source")
    old = docs.where(odd).withColumn("text", F.concat(F.lit("old words "), F.substring("text", 1, 100)))
    strangers = docs.where("seq % 5 = 0").select(F.concat(F.lit("x/"), "source").alias("source"), "text", "type", "seq")
    store.publish(chunked(docs.where(~odd).unionByName(old).unionByName(strangers)), none)
    store.publish(chunked(docs.where(odd)), docs.where(odd).select("source"))
    store.publish(None, strangers.select("source"))
    return retrieval.bm25(store.index(), benchmark_queries(spark, sf), 5).select("query_id", "rank", "id", r6("score").alias("score"))


def scoped_exact(spark, sf):
    """All benchmark items as queries among the documents of one folder."""
    found = retrieval.scoped(index(spark, sf), benchmark_queries(spark, sf), "src3/en", 5, exact=True)
    return found.select("query_id", "rank", "id", r6("score").alias("score"))


def dense_batch(spark, sf):
    """Every vector as a query against all vectors."""
    rows = tables.vectors(spark, sf)
    found = retrieval.dense(rows, rows.select(F.col("id").cast("string").alias("query_id"), "vector"), 5)
    return found.select("query_id", "rank", "id", r6("score").alias("score"))


def bm25_explain(spark, sf):
    found = retrieval.bm25(index(spark, sf), asked(spark), 10)
    parts = found.select("rank", "id", F.posexplode("contributions").alias("place", "c"))
    return parts.select("rank", "id", "place", F.col("c.term").alias("term"), r6("c.score").alias("share"))


def scoped(pattern: str):
    def run(spark, sf):
        return retrieval.scoped(index(spark, sf), asked(spark), pattern, 10).select("rank", "id", "source", r6("score").alias("score"))

    return run


def source_filters(spark, sf):
    """How many documents and pages each pattern keeps."""
    sources = tables.documents(spark, sf).select("source").unionByName(tables.pages(spark, sf).select("source"))
    patterns = ["", "*.txt", ".TXT", "src3", "SRC3/en", "en", "src", "/", "https://", "https://ex", "src1\\de"]
    counts = [F.count(F.when(in_scope(p), 1)).alias(f"p{i}") for i, p in enumerate(patterns)]
    one = sources.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{i}").alias("kept")) for i, p in enumerate(patterns)])).alias("r")).select("r.*")


def dense_search(spark, sf):
    rows = tables.vectors(spark, sf)
    query = rows.where("id = 0").select(F.lit("q").alias("query_id"), "vector")
    return retrieval.dense(rows, query, 10).select("rank", "id", r6("score").alias("score"))


def hybrid_rrf(spark, sf):
    idx = index(spark, sf)
    vecs = vectors.hashed(idx.chunks, keep=("seq",))
    q = vectors.hashed(asked(spark).withColumnRenamed("query", "text"), "query_id")
    depth = retrieval.RRF_DEPTH
    return retrieval.fused([retrieval.bm25(idx, asked(spark), depth), retrieval.dense(vecs, q, depth)], 10).select("rank", "id", r6("score").alias("score"))


def rerank_grades(spark, sf):
    idx = index(spark, sf)
    first = retrieval.bm25(idx, asked(spark), retrieval.RERANK_DEPTH)
    grades = retrieval.coverage_grades(idx, asked(spark), first)
    return retrieval.reranked(first, grades, 10).select("rank", "id", F.col("score").cast("int").alias("grade"))


def grades_parsed(spark, sf):
    """Grades from JSON answers, one answer per benchmark item, which quotes the item."""
    items = tables.read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), (F.char_length("text") % 13 - 1).cast("int").alias("g"), "text")
    grades = [F.struct(F.lit(p).alias("passage"), g.alias("grade")) for p, g in ((1, F.col("g")), (2, F.lit(99)), (1, F.lit(3)), (7, F.lit(5)))]
    answer = F.to_json(F.struct(F.array(*grades).alias("grades"), F.col("text").alias("quoted")))
    return retrieval.parsed_grades(items.select("query_id", answer.alias("answer"), F.lit(3).alias("count")))


def highlights(spark, sf):
    rows = tables.documents(spark, sf).select("source", F.explode(T.highlights("text", T.tokenize(QUERY))).alias("h"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.min("h.start").alias("first"), F.max("h.end").alias("last"), F.sum("h.start").alias("starts"))


def passage_spans(spark, sf):
    """Where each document's windows stand in its text."""
    docs = tables.documents(spark, sf)
    found = chunking.windows(docs.select("source", "text"), 50, 10).select("source", "position", F.col("text").alias("passage"))
    return passages.located(docs, found, whole=True).select("source", "position", "start", "end")


def docs_by_type(spark, sf):
    docs = index(spark, sf).chunks.select("source").unionByName(tables.pages(spark, sf).select("source")).distinct()
    return docs.groupBy(T.file_type("source").alias("type")).agg(F.count(F.lit(1)).alias("documents"))


def chunk_histogram(spark, sf):
    return analytics.chunk_histogram(index(spark, sf), 10)


def recent_documents(spark, sf):
    return analytics.recent_documents(index(spark, sf), 10)


def catalog(spark, sf):
    return analytics.catalog(index(spark, sf)).select("source", "chunks", joined("chunk_ids").alias("chunk_ids"))


def doc_top_terms(spark, sf):
    return analytics.document_terms(index(spark, sf)).select("source", "rank", "term", r6("weight").alias("weight"))


def doc_relations(spark, sf):
    return analytics.relations(index(spark, sf)).select("first", "second", "strength", joined("shared_terms").alias("shared_terms"))


def _cases(spark, sf) -> DataFrame:
    """Benchmark items with the documents that hold all their words in order."""
    items = tables.read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return evaluation.holders(tables.documents(spark, sf), items)


def eval_outcomes(spark, sf):
    ranking = retrieval.bm25(index(spark, sf), benchmark_queries(spark, sf), 5)
    done = evaluation.outcomes(ranking, _cases(spark, sf), 5)
    curve = joined(F.transform("recall_curve", lambda x: F.format_number(x, 4)))
    return done.select("query_id", "first_hit", curve.alias("recall_curve"))


def eval_report(spark, sf):
    ranking = retrieval.bm25(index(spark, sf), benchmark_queries(spark, sf), 5)
    return evaluation.report(evaluation.outcomes(ranking, _cases(spark, sf), 5), 5).select("cases", r6("recall").alias("recall"), r6("mrr").alias("mrr"))


def cited_documents(spark, sf):
    idx = index(spark, sf)
    found = idx.chunks.select("id", "indexed_at").join(F.broadcast(retrieval.bm25(idx, asked(spark), 20)), "id")
    return answers.cited_documents(found).select("source", "indexed_at", "best_rank", joined("ranks").alias("ranks"))


def answer_overlap(spark, sf):
    idx = index(spark, sf)
    a = retrieval.bm25(idx, asked(spark), 10)
    b = retrieval.bm25(idx, asked(spark, "eronly thonan"), 10)
    return answers.compared(a, b).select(F.size("shared").alias("shared"), r6("overlap").alias("overlap"))


PRICES = [("base", 4.0, 20.0, 0.2), ("base-large", 10.0, 50.0, 0.25), ("mini", 0.1, 0.5, 0.01)]


def usage_cost(spark, sf):
    """Costs of one call per conversation turn; the model's name follows the conversation's id."""
    model = F.element_at(F.array(*map(F.lit, ["base", "base-large-2", "mini-1", "other", "basement"])), (F.col("conv_id") % 5 + 1).cast("int"))
    n = F.char_length(F.coalesce("text", F.lit("")))
    usage = tables.read(spark, sf, "conversations").select("conv_id", "turn", model.alias("model"), n.alias("input_tokens"), (n % 97).alias("output_tokens"), F.when(F.col("turn") % 2 == 0, n % 31).alias("cache_created"), (n % 53).alias("cache_read_tokens"))
    prices = spark.createDataFrame(PRICES, "model string, input double, output double, cache_read double")
    return answers.costs(usage, prices).select("conv_id", "turn", "model", r6("cost_usd").alias("cost_usd"))


def chat_window(spark, sf):
    return answers.last_turns(tables.read(spark, sf, "conversations"), 3).select("conv_id", "turn", "role")


def chat_window_stream(spark, sf):
    """The turns that conversations remember after all of them went through the stream."""
    home = f"{shared_dir(spark)}/conversations-{uuid.uuid4().hex}"
    rows = tables.read(spark, sf, "conversations")
    table = conversations.replayed(spark, f"{sf}/conversations.parquet", home, 3, rows.schema)
    return conversations.windows(table).select(F.col("conv_id").cast("long").alias("conv_id"), "turn")


def sql_sentence_chunks(spark, sf):
    """sentence_chunks by its table function."""
    register(spark)
    tables.documents(spark, sf).select("source", "text").createOrReplaceTempView("glosspan_docs")
    return spark.sql("SELECT id, source, position, text FROM sentence_chunks(TABLE(glosspan_docs) PARTITION BY (source), 200, 40)")


def sql_search(spark, sf):
    """bm25_explain by its table function."""
    register(spark, index(spark, sf))
    return spark.sql(f"SELECT rank, id, place, term, round(share, 6) AS share FROM explain_search('{QUERY}', 10)")


def folded_filters(spark, sf):
    """Documents of folders whose names differ from the pattern in case beyond ASCII."""
    docs = tables.documents(spark, sf).select(F.concat(F.element_at(F.array(*map(F.lit, ["Straße", "STRASSE", "ΣΟΦΟΣ", "σοφος", "plain"])), (F.col("seq") % 5 + 1).cast("int")), F.lit("/"), "source").alias("source"))
    return docs.where(in_scope("strasse") | in_scope("σοφοσ"))


def prompt_budget(spark, sf):
    rows = answers.budgeted(index(spark, sf).chunks, 2500)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.max("omitted").alias("omitted"), F.sum(F.char_length("text")).alias("chars"))


def segments_merge(spark, sf):
    """The stretches of each document that the 200 best passages for a query cover."""
    idx = index(spark, sf)
    # The 200 best are sent to the tables, which are not shuffled for them.
    best = idx.chunks.select("id", F.col("text").alias("passage")).join(F.broadcast(retrieval.bm25(idx, asked(spark), 200)), "id").persist()
    docs = tables.documents(spark, sf).join(F.broadcast(best.select("source").distinct()), "source", "left_semi")
    spans = passages.located(docs, best.select("source", "rank", "passage"), whole=True)
    return answers.merged_segments(spans.select("source", "rank", "start", "end")).select("source", "start", "end", joined("ranks").alias("ranks"))


def paged_windows(spark, sf):
    """Windows with page ranges, when every line of a document is a page."""
    docs = tables.documents(spark, sf).select("source", F.split("text", "\n").alias("pages"))
    paged = docs.select("source", F.array_join("pages", "\n\n").alias("text"), T.page_offsets("pages").alias("page_offsets"))
    return chunking.windows(paged, 60, 12).select("id", "position", "first_page", "last_page", T.citation().alias("citation"))


def emphasized(spark, sf):
    rows = tables.documents(spark, sf).select("source", "text", T.highlights("text", T.tokenize(QUERY)).alias("found"))
    return rows.select("source", F.md5(T.emphasized("text", "found").cast("binary")).alias("text_md5"), F.size("found").alias("hits"))


def source_hrefs(spark, sf):
    docs = tables.documents(spark, sf).select(F.concat(F.lit("/my docs/"), "source").alias("source"), F.when(F.col("seq") % 2 == 0, (F.col("seq") % 9).cast("int")).alias("first_page"))
    return docs.unionByName(tables.pages(spark, sf).select("source", F.lit(3).alias("first_page"))).select("source", T.source_href().alias("href"))


def document_labels(spark, sf):
    """Short labels of files, some of which share their name with another."""
    named = F.concat(F.col("source"), F.lit("/"), F.col("seq") % 400, F.lit(".txt"))
    return labels(tables.documents(spark, sf).select(named.alias("source")))


def edge_labels(spark, sf):
    return analytics.relations(index(spark, sf)).select("first", "second", edge_label().alias("edge"))


def score_breakdown(spark, sf):
    return retrieval.bm25(index(spark, sf), asked(spark), 10).select("rank", "id", T.breakdown("contributions").alias("parts"))


def label_texts(spark, sf):
    """What is shown of time stamps and of the usage of a call, over all conversation turns."""
    rows = tables.read(spark, sf, "conversations").withColumn("n", F.char_length(F.coalesce("text", F.lit(""))) * 37)
    stamp = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, "soon").otherwise(F.concat(F.lit("2026-03-0"), F.col("turn") % 7 + 1, F.lit("T10:0"), F.col("conv_id") % 10, F.lit(":30+00:00")))
    cost = F.when(F.col("turn") % 2 == 0, F.col("n") / F.lit(8192.0))
    return rows.select("conv_id", "turn", T.indexed_label(stamp).alias("indexed"), T.usage_summary(F.lit("m"), "n", F.col("n") % 3 * 1000, F.col("n") % 5000, cost).alias("usage"))


def chunk_lookup(spark, sf):
    """The chunks of the document with the most chunks, in order."""
    idx = index(spark, sf)
    most = idx.chunks.groupBy("source").count().orderBy(F.desc("count"), "source").first()["source"]
    return analytics.chunks_of(idx, most).select("id", "position", F.sha2("text", 256).alias("text_sha"))


def ignored_files(spark, sf):
    """Watched files when two folders are ignored, one of which holds a watched root."""
    paths = tables.documents(spark, sf).select(F.concat(F.lit("/w/"), "source").alias("path"))
    return paths.where(~ignored("path", ["/w/src1/en", "/w/src2", "/w"], ["/w/src2/de", "/w"]))


def prompt_context(spark, sf):
    """The numbered passages that a question's prompt holds."""
    idx = index(spark, sf)
    found = idx.chunks.drop("source", "seq", "position").join(F.broadcast(retrieval.bm25(idx, benchmark_queries(spark, sf), 3)), "id")
    return answers.context(found).select("query_id", F.md5(answers.prompt("Why?").cast("binary")).alias("prompt_md5"))


def citation_links(spark, sf):
    """Which citations of a text count, when its sources are fewer than it cites, and the text with links."""
    items = tables.read(spark, sf, "benchmark").select("item_id", F.concat("text", F.lit(" ["), F.col("item_id") % 7, F.lit("] and [2], ["), F.col("item_id") % 5, F.lit("](x) [12] [007]")).alias("text"), (F.col("item_id") % 4 + 1).alias("sources"))
    link = lambda n: F.concat(F.lit("<"), n, F.lit(">"))
    return items.select("item_id", joined(answers.citations("text", F.col("sources"))).alias("cited"), answers.linked("text", F.col("sources"), link).alias("linked"))


def text_fragments(spark, sf):
    """Fragment directives of every chunk of 14 words of the documents."""
    rows = chunking.windows(tables.documents(spark, sf).select("source", "text"), 14, 0)
    marked = rows.withColumn("found", T.highlights("text", T.tokenize(QUERY)))
    return marked.select("id", joined(T.text_directives("text", "found"), "&").alias("directives"))


def incremental_changed(spark, sf):
    """Documents to index again when every seventh known text was another one."""
    docs = tables.documents(spark, sf).withColumn("content_hash", T.content_hash("text"))
    known = docs.select("source", F.when(F.col("seq") % 7 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return changed_only(docs, known).select("source")


def snapshot_diff(spark, sf):
    docs = tables.read(spark, sf, "documents")
    path, size = F.concat(F.lit("/d/"), F.col("doc_id")).alias("path"), F.col("n_chars").alias("size")
    before = docs.where("doc_id % 5 <> 0").select(path, F.col("doc_id").alias("mtime"), size)
    now = docs.where("doc_id % 7 <> 0").select(path, F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime"), size)
    return watch.difference(before, now)


def remove_path(spark, sf):
    left = index(spark, sf).where(~under_path("src3/en")).chunks
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def remove_url(spark, sf):
    pages = tables.pages(spark, sf)
    return pages.where(~under_url("https://example.com/a")).select("source")


def dedup_hash(spark, sf):
    docs = tables.documents(spark, sf)
    return docs.groupBy(T.content_hash("text").alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("source").alias("first"))


def upsert_chunks(spark, sf):
    """Known chunks of every tenth document replaced by shorter ones; the ids that stay and their lengths."""
    idx = Index.of(tables.documents(spark, sf))
    new = idx.chunks.where("seq % 10 = 0").withColumn("text", F.substring("text", 1, 20))
    return idx.upsert(new).chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("text")).alias("chars"))


def loader_dispatch(spark, sf):
    """What would load each document and page if its source were a path."""
    from glosspan.sources.files import loader

    suffixes = [".txt", ".MD", ".html", ".docx", ".pdf", ".bin", ""]
    docs = tables.read(spark, sf, "documents").select(F.concat(F.lit("dir.x/f"), F.col("doc_id"), F.element_at(F.array(*map(F.lit, suffixes)), (F.col("doc_id") % 7 + 1).cast("int"))).alias("source"))
    return docs.groupBy(F.coalesce(loader(), F.lit("skipped")).alias("loader")).agg(F.count(F.lit(1)).alias("files"))


def text_functions(spark, sf):
    """Scalar functions over all documents."""
    docs = tables.documents(spark, sf)
    n = F.char_length("text")
    return docs.select("source", T.preview("text", 40).alias("preview"), T.human_size(n * 1000).alias("size"), T.plural(n % 3, "page").alias("pages"), T.source_matches("source", F.lit("en/1.txt")).alias("matches"), T.word_count("text").cast("long").alias("words"))


def vector_cache_missing(spark, sf):
    docs = tables.documents(spark, sf)
    cache = docs.where("seq % 3 = 0").select(T.content_hash("text").alias("text_sha"), F.when(F.col("seq") % 2 == 0, "a").otherwise("b").alias("model"))
    return vectors.missing(docs, cache, "a").select("text_sha")


def pages_main_content(spark, sf):
    return html.to_text(tables.pages(spark, sf)).select("source", "title", "text")


def pages_chunks(spark, sf):
    docs = html.to_text(tables.pages(spark, sf)).select("source", "text", F.lit("html").alias("type"))
    return chunking.by_type(docs).select("id", "source", "position", "section", "text", T.citation().alias("citation"))


def sentence_chunks(spark, sf):
    return chunking.packed_sentences(tables.documents(spark, sf).select("source", "text")).select("id", "source", "position", "text")


def markdown_sections(spark, sf):
    """Whole pages as Markdown, one row per chunk of a section."""
    docs = html.to_text(tables.pages(spark, sf), main=False).select("source", "text")
    return chunking.markdown(docs).groupBy("source", "section").agg(F.count(F.lit(1)).alias("chunks"), F.min("position").alias("first"))


def pca_map(spark, sf):
    points = analytics.pca_map(tables.vectors(spark, sf))
    return points.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def watch_apply(spark, sf):
    """The index after a batch that changes every tenth document and removes every eleventh."""
    docs = tables.documents(spark, sf)
    idx = Index.of(docs)
    kind = F.when(F.col("seq") % 11 == 0, "removed").when(F.col("seq") % 10 == 0, "changed")
    changes = docs.select(F.col("source").alias("path"), kind.alias("kind")).where("kind IS NOT NULL")

    def read(paths):
        return docs.join(paths.withColumnRenamed("path", "source"), "source", "left_semi").withColumn("text", F.concat("text", F.lit(" more words")))

    return watch.applied(idx, changes, read, STAMP).chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.max("indexed_at").alias("indexed_at"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_window, tokens_stats, top_terms, index_stats, bm25_search, bm25_batch, bm25_bounded, segmented_search, scoped_exact, dense_batch, bm25_explain, source_filters, dense_search, hybrid_rrf, rerank_grades, grades_parsed, highlights, passage_spans,
        docs_by_type, chunk_histogram, recent_documents, catalog, doc_top_terms, doc_relations, eval_outcomes, eval_report, cited_documents, answer_overlap, usage_cost, chat_window, chat_window_stream, sql_sentence_chunks, sql_search, folded_filters, prompt_budget,
        segments_merge, incremental_changed, snapshot_diff, remove_path, remove_url, dedup_hash, upsert_chunks, loader_dispatch, text_functions, vector_cache_missing, pages_main_content, pages_chunks,
        sentence_chunks, markdown_sections, pca_map, watch_apply, paged_windows, emphasized, source_hrefs, document_labels, edge_labels, score_breakdown, label_texts, chunk_lookup, ignored_files,
        prompt_context, citation_links, text_fragments,
    )
} | {"bm25_scoped_type": scoped("*.txt"), "bm25_scoped_folder": scoped("src3/en"), "bm25_scoped_url": scoped("https://example.com")}
