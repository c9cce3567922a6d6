"""One saved index and what can be done with it: the services behind the command line and the servers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.functions import text as T
from glosspan.operators import analytics, answers, chunking, evaluation, passages, retrieval, vectors
from glosspan.operators.filters import changed_only, under_path, under_url
from glosspan.operators.index import Index, chunked
from glosspan.operators.segments import VECTORS, Segments
from glosspan.sources import files, settings, web
from glosspan.streaming.watch import Watcher


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def is_address(target: str) -> bool:
    return target.lower().startswith(("http://", "https://"))


@dataclass
class Report:
    """What a run did; reports add up."""

    indexed: int = 0
    unchanged: int = 0
    chunks: int = 0
    skipped: list[str] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)

    def __add__(self, other: Report) -> Report:
        return Report(*(getattr(self, f) + getattr(other, f) for f in self.__dataclass_fields__))


@dataclass
class Ports:
    """What an engine may be given in place of its own parts."""

    generate: Callable[..., answers.Generated | str] = answers.extractive
    embedder: vectors.Embedder = field(default_factory=vectors.Hashed)
    grade: Callable[[Index, DataFrame, DataFrame], DataFrame] = retrieval.coverage_grades
    project: Callable[[DataFrame], DataFrame] = analytics.pca_map
    tokenizer: T.Tokenizer = T.DEFAULT
    prices: list[tuple[str, float, float, float]] = field(default_factory=list)
    #: What a call cost, given its usage; by default from ``prices``.
    estimate: Callable[[answers.Usage], float | None] | None = None
    #: Highlights of a text column for some terms.
    highlight: Callable[..., Column] = T.highlights
    #: Where a result row's passage is opened, as a column over source, first_page, text, highlights, matched_terms.
    locate: Callable[[], Column] = T.passage_href
    #: (documents, size, overlap) to chunks; by default the chunkers of the settings.
    chunk: Callable[[DataFrame, int, int], DataFrame] | None = None
    #: What reads a kind of file: (content, name) to (text, title, page offsets).
    parsers: dict[str, Callable[[bytes, str], tuple]] = field(default_factory=lambda: dict(files.PARSERS))
    #: What fetches a URL.
    fetch: Callable[[str], tuple] = web.fetch
    #: The index below a folder, as Segments gives it.
    repository: Callable[..., Segments] = Segments
    #: Renderers by report and form, before those of the library.
    renderers: dict[tuple[str, str], Callable[..., str]] = field(default_factory=dict)


class Engine:
    """Opens the newest version of the index for each call, so changes by others are seen."""

    def __init__(self, spark: SparkSession, options: settings.Settings | None = None, clock: Callable[[], str] = now, generate: Callable | None = None, ports: Ports | None = None):
        self.spark, self.options, self.clock = spark, options or settings.Settings(), clock
        self.ports = ports or Ports()
        if generate is not None:
            self.ports = replace(self.ports, generate=generate)
        self.segments = self.ports.repository(spark, self.options.index_path, self.ports.tokenizer)
        self.store = self.segments.store

    # The index.

    def index(self) -> Index:
        return self.segments.index()

    def _publish(self, documents: DataFrame | None, gone: DataFrame, read: int, applied: dict[str, int] | None = None) -> None:
        """The next version: these documents (numbered from 0) in place of what the sources ``gone`` had."""
        chunks = None
        if documents is not None:
            chunks = chunked(documents.withColumn("seq", F.col("seq") + F.lit(self.segments.next_seq())), **self._options())
        embed = None if self.options.retriever == "bm25" else self._vectors
        self.segments.publish(chunks, gone, read, applied, embed)

    def _read_version(self) -> int:
        return self.segments.version()

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        """(id, source, seq, position, model, vector): each text that the cache lacks is embedded once and added to it."""
        home, path = self.ports.embedder, f"{self.store.path}/cache/vectors"
        empty = self.spark.createDataFrame([], vectors.CACHE)

        def known() -> DataFrame:
            held = self.spark.read.schema(vectors.CACHE).parquet(path) if self.store.has(f"{self.store.path}/cache", "vectors") else empty
            return held.where(F.col("model") == home.model).dropDuplicates(["text_sha"])

        _, new = vectors.cached(chunks.select("text"), known(), home)
        new = new.persist()
        if not new.isEmpty():
            new.write.mode("append").partitionBy("model").parquet(path)
        new.unpersist()
        keyed = chunks.select("id", "source", "seq", "position", T.content_hash("text").alias("text_sha"))
        return keyed.join(known(), "text_sha").select(*[f.split(" ")[0] for f in VECTORS.split(", ")])

    def vectors(self, index: Index) -> DataFrame:
        """The newest version's vectors, if they are this embedder's; else made from the cache."""
        kept = self.segments.vectors()
        if kept is not None and kept.where(F.col("model") != self.ports.embedder.model).isEmpty():
            return kept
        return self._vectors(index.chunks)

    def _options(self) -> dict:
        body = self.options.chunker
        made = self.ports.chunk or (lambda rows, size, overlap: chunking.by_type(rows, size, overlap, body))
        return {"chunker": made, "size": self.options.chunk_size, "overlap": self.options.chunk_overlap, "indexed_at": self.clock()}

    def _store(self, parsed: DataFrame, force: bool) -> Report:
        parsed = parsed.withColumn("seq", F.monotonically_increasing_id()).cache()
        good = parsed.where("failed IS NULL").select("source", "text", "type", "page_offsets", "seq")
        failed = [(r["source"], r["failed"]) for r in parsed.where("failed IS NOT NULL").select("source", "failed").collect()]
        version, before = self._read_version(), self.index()
        hashed = good.withColumn("content_hash", T.content_hash("text"))
        todo = hashed if force else hashed.join(before.hashes(), ["source", "content_hash"], "left_anti")
        total, fresh, made = good.count(), todo.count(), 0
        if fresh:
            self._publish(todo.drop("content_hash"), todo.select("source"), version)
            made = self.index().sources().join(todo.select("source"), "source", "left_semi").agg(F.sum("chunks")).first()[0] or 0
        parsed.unpersist()
        return Report(fresh, total - fresh, made, [], failed)

    def index_paths(self, *paths: str, force: bool = False) -> Report:
        done = Report()
        for path in paths:
            listing = files.listed(self.spark, path)
            done += self._store(files.documents(listing, self.ports.parsers), force)
            done.skipped += [r["source"] for r in files.skipped(listing).orderBy("source").collect()]
        return done

    def index_urls(self, *urls: str, force: bool = False, fetcher: Callable[[str], tuple] | None = None) -> Report:
        fetched = web.fetched(self.spark.createDataFrame([(u,) for u in urls], "url string"), fetcher or self.ports.fetch)
        return self._store(web.documents(fetched).withColumn("page_offsets", F.lit(None).cast("array<int>")), force)

    def apply(self, changes: DataFrame, applied: dict[str, int] | None = None) -> int:
        """One batch of watched changes (path, kind), published with the marks ``applied``; how many documents it changes.

        Changed files are read in tasks, no others; those whose text is indexed
        already are not indexed again.
        """
        version, index = self._read_version(), self.index()
        good = files.documents(files.opened(changes.where("kind = 'changed'")), self.ports.parsers).where("failed IS NULL")
        fresh = changed_only(good.withColumn("content_hash", T.content_hash("text")), index.hashes()).drop("content_hash")
        fresh = fresh.select("source", "text", "type", "page_offsets").withColumn("seq", F.monotonically_increasing_id()).persist()
        removed = changes.where("kind = 'removed'").select(F.col("path").alias("source")).join(index.sources().select("source"), "source", "left_semi")
        gone = fresh.select("source").unionByName(removed).persist()
        count = gone.count()
        self._publish(fresh if count else None, gone, version, applied)
        gone.unpersist()
        fresh.unpersist()
        return count

    def remove(self, target: str) -> int:
        """Documents at or below a path or URL; nothing is written if there are none.

        A path is taken as indexing names it, so a relative one finds what it indexed.
        """
        condition = under_url(target) if is_address(target) else under_path(files.resolved(self.spark, target)) | under_path(target)
        version, index = self._read_version(), self.index()
        gone = index.sources().where(condition).select("source").persist()
        count = gone.count()
        if count:
            self._publish(None, gone, version)
        gone.unpersist()
        return count

    def watch(self, *roots: str, ignored: list[str] | None = None, after: Callable[[DataFrame], None] | None = None) -> Watcher:
        return Watcher(self, *roots, ignored=ignored, after=after)

    # Searching.

    def search(self, query: str, top_k: int | None = None, source: str = "") -> DataFrame:
        """Ranked passages with highlights and matched terms; a blank query finds nothing."""
        index, k = self.index(), top_k or self.options.top_k
        asked = retrieval.asked(index, q=query)
        plain = self.options.retriever == "bm25" and not self.options.rerank
        found = retrieval.scoped(index, asked, source, k, retrieval.bm25 if plain else lambda i, q, n: self._search(i)(q, n))
        return retrieval.with_passages(found, index, query, self.ports.highlight).withColumn("href", self.ports.locate())

    def _search(self, index: Index) -> Callable[[DataFrame, int], DataFrame]:
        kind, home = self.options.retriever, self.ports.embedder
        kept = None if kind == "bm25" else self.vectors(index).drop("model")
        find = retrieval.retriever(kind, index, kept, lambda q: home.embed(q, "query_id", "query"), self.options.rerank, self.ports.grade, self.options.rerank_candidates)
        places = index.chunks.select("id", F.col("source").alias("_source"), F.col("seq").alias("_seq"), F.col("position").alias("_position"))

        def run(queries: DataFrame, k: int) -> DataFrame:
            found = find(queries, k).join(places, "id")
            parts = "contributions" if "contributions" in found.columns else F.lit(None).cast("array<struct<term:string,score:double>>").alias("contributions")
            return found.select("query_id", "id", F.col("_source").alias("source"), F.col("_seq").alias("seq"), F.col("_position").alias("position"), "score", "rank", parts)

        return run

    def evaluate(self, cases: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
        index = self.index()
        ranking = self._search(index)(cases.select("query_id", "query"), k)
        done = evaluation.outcomes(ranking, cases, k)
        return done, evaluation.report(done, k)

    def held(self, rows: DataFrame) -> DataFrame:
        """A result of bounded size (the top k) computed once and held on the driver, so that nothing stays in storage."""
        return self.spark.createDataFrame(rows.collect(), rows.schema)

    # Answering.

    def ask(self, question: str, top_k: int | None = None, source: str = "", on_text: Callable[[str], None] | None = None) -> tuple[str, DataFrame]:
        found = self.search(question, top_k, source)
        return answers.answer(question, found, self.ports.generate, on_text), found

    def answer(self, question: str, top_k: int | None = None, source: str = "", on_text: Callable[[str], None] | None = None) -> answers.Answer:
        """The answer with its passages, the usage of the call that made it and its cost."""
        found = self.held(self.search(question, top_k, source))
        made = answers.generated(question, found, self.ports.generate, on_text)
        return answers.Answer(question, made.text, found, made.usage, self.cost(made.usage))

    def cost(self, usage: answers.Usage | None) -> float | None:
        if usage is not None and self.ports.estimate is not None:
            return self.ports.estimate(usage)
        if usage is None or not self.ports.prices:
            return None
        rows = self.spark.createDataFrame([usage.row()], answers.USAGE)
        prices = self.spark.createDataFrame(self.ports.prices, "model string, input double, output double, cache_read double")
        return answers.costs(rows, prices).first()["cost_usd"]

    def chat(self) -> answers.Chat:
        return answers.Chat(self.search, self.ports.generate, self.options.history)

    def changed(self, *pairs: str) -> Engine:
        """An engine over the same index with some settings changed and the same ports."""
        return Engine(self.spark, replace(self.options, **settings.changes(list(pairs))), self.clock, ports=self.ports)

    def compare(self, question: str, *pairs: str) -> DataFrame:
        """Overlap of the passages found with these settings and with some of them changed."""
        return answers.compared(self.search(question).select("id", "rank"), self.changed(*pairs).search(question).select("id", "rank"))

    def comparison(self, question: str, *pairs: str, source: str = "") -> answers.Comparison:
        """Two answers to one question, with these settings and with some of them changed."""
        other = self.changed(*pairs)
        sides = [answers.Variant(settings.label(e.options), e.answer(question, source=source)) for e in (self, other)]
        both = answers.compared(*(s.answer.passages.select("id", "rank") for s in sides)).first()
        return answers.Comparison(question, *sides, list(both["shared"]), both["overlap"])

    # Looking.

    def overview(self) -> dict[str, DataFrame]:
        index = self.index()
        points = self.ports.project(self.vectors(index).select("id", "vector"))
        named = points.join(index.chunks.select("id", "source"), "id")
        return analytics.overview(index) | {"catalog": analytics.catalog(index), "map": named}

    def cited_texts(self, made: answers.Answer) -> DataFrame:
        """The documents that an answer cites and that can be read again: source, text, segments.

        A segment is a stretch that one cited passage covers or several that
        overlap: start, end, ranks, and highlights of the question's terms as
        offsets from its start.
        """
        index, passages_of = self.index(), made.passages.select("source", "rank", F.col("text").alias("passage"))
        cited = passages_of.select("source").distinct().where(~T.is_url(F.col("source")))
        texts = files.documents(files.opened(cited.select(F.col("source").alias("path"))), self.ports.parsers).where("failed IS NULL").select("source", "text").persist()
        spans = passages.located(texts, passages_of).where("start IS NOT NULL")
        segments = answers.merged_segments(spans.select("source", "rank", "start", "end"))
        inside = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
        marked = segments.join(texts, "source").withColumn("highlights", self.ports.highlight(inside, index.tokenizer.terms(made.question), index.tokenizer))
        found = marked.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ranks", "highlights"))).alias("segments"))
        return texts.join(found, "source").select("source", "text", "segments")

    def source_page(self, chunk_id: str, texts: DataFrame | None = None, query: str = "") -> DataFrame:
        """One row: a chunk's document, the passage's place in it and highlights inside that.

        ``texts`` (source, text) are the documents' texts; without them the
        chunk's own source is read again.  No row for an unknown chunk, or a
        source that cannot be read.
        """
        index = self.index()
        passage = index.chunks.where(F.col("id") == chunk_id).select("source", F.col("text").alias("passage"))
        if texts is None:
            found = passage.first()
            text = files.text_of(self.spark, found["source"]) if found else None
            texts = self.spark.createDataFrame([(found["source"], text)] if text is not None else [], "source string, text string")
        row = passages.located(texts, passage).join(texts, "source").withColumn("span", F.when(F.col("start").isNotNull(), F.struct("start", "end")))
        inside = F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
        marks = F.transform(self.ports.highlight(inside, index.tokenizer.terms(query), index.tokenizer), lambda h: F.struct((h["start"] + F.col("span.start")).alias("start"), (h["end"] + F.col("span.start")).alias("end"), h["term"].alias("term")))
        return row.select("source", "text", F.col("span.start").alias("passage_start"), F.col("span.end").alias("passage_end"), marks.alias("highlights"))

    def __len__(self) -> int:
        return self.index().totals()[0]

