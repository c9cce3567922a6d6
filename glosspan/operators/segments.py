"""An index of immutable segments: a batch writes what it brings, not what is there.

A segment holds the chunks, postings and documents of one batch, and the sources
that the batch replaced or removed (``gone``).  A row is live unless a later
segment names its source.  A version is a small table that lists the segments
with their counts; it is published by one rename, and versions share segments.

When FANOUT segments of one level stand at the end, they are merged into one of
the next level, so a row is rewritten once a level and reading opens a number of
segments that grows with the logarithm of the index.  A merge reads those
segments only; names in ``gone`` stay as long as there are older segments.

Counts are exact at any time: a batch looks up what its sources had, and the
version keeps the live totals.  The number of documents a term is in is counted
from live postings, of the terms of a query.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.functions.text import DEFAULT, Tokenizer
from glosspan.operators.index import BOUNDS, CHUNKS, PACKED, ZSTD, Index, packed, unpacked, write_postings
from glosspan.store import Store

FANOUT = 4
POSTINGS = "id string, source string, seq long, position int, term string, tf long, length long"
SOURCES = "source string, content_hash string, seq long, chunks long, terms long"
GONE = "source string"
VECTORS = "id string, source string, seq long, position int, model string, vector array<double>"
SCHEMAS = {"chunks": CHUNKS, "postings": POSTINGS, "sources": SOURCES, "gone": GONE, "vectors": VECTORS, "blocks": BOUNDS}
#: The list of segments: their order, level, rows of each table, and the live totals of the index after them.
LISTED = "segment string, place long, level int, chunks long, postings long, sources long, gone long, vectors boolean"
HEAD = "live_chunks long, live_terms long, last_seq long, applied map<string,long>"
#: Names in ``gone`` up to this many are sent to every task, at some 100 bytes each.
SENT = 100_000
#: More of them, up to this many, are sent as hashes, at some 60 bytes each; beyond that rows are shuffled.
HASHED = 1 << 22


class Segments:
    """The segmented index below a folder."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer = DEFAULT, fanout: int = FANOUT):
        self.spark, self.path, self.tokenizer, self.fanout = spark, str(path).rstrip("/"), tokenizer, fanout
        self.store = Store(spark, self.path)
        self._told: dict[tuple, bool] = {}

    # Reading.

    def version(self) -> int:
        found = self.store.versions()
        return found[-1] if found else 0

    def listed(self, version: int | None = None) -> list:
        """The segments of a version, oldest first: a few rows."""
        number = self.version() if version is None else version
        return self.spark.read.schema(LISTED).parquet(f"{self.path}/v{number}/segments").orderBy("place").collect() if number else []

    def head(self, version: int | None = None):
        number = self.version() if version is None else version
        return self.spark.read.schema(HEAD).parquet(f"{self.path}/v{number}/head").first() if number else None

    def _table(self, segment: str, name: str) -> DataFrame:
        rows = self.spark.read.schema(PACKED if name == "postings" else SCHEMAS[name]).parquet(f"{self.path}/segments/{segment}/{name}")
        return unpacked(rows) if name == "postings" else rows

    def _all(self, segments: list, name: str) -> DataFrame:
        """The rows of a table in these segments, dead ones too, with their segment's place."""
        parts = [self._table(s["segment"], name).withColumn("_place", F.lit(s["place"])) for s in segments if s[name]]
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{SCHEMAS[name]}, _place long")

    def live(self, segments: list, name: str, within: DataFrame | None = None) -> DataFrame:
        """The rows that no later segment of the list replaces; ``within`` is those rows already narrowed."""
        rows = self._all(segments, name) if within is None else within
        later = [s for s in segments[1:] if s["gone"]]
        if later:
            names = sum(s["gone"] for s in later)
            hashed = SENT < names <= HASHED and self._told_apart(segments)
            key = F.xxhash64("source") if hashed else F.col("source")
            cut = self._all(later, "gone").groupBy(key.alias("_key")).agg(F.max("_place").alias("_cut"))
            if hashed or names <= SENT:
                cut = F.broadcast(cut)
            rows = rows.withColumn("_key", key).join(cut, "_key", "left").where(F.col("_cut").isNull() | (F.col("_place") >= F.col("_cut"))).drop("_key", "_cut")
        return rows.drop("_place")

    def _told_apart(self, segments: list) -> bool:
        """Whether all sources that these segments have or name have hashes of their own, so that hashes are as good as names."""
        held = tuple(s["segment"] for s in segments)
        if held not in self._told:
            names = self._all(segments, "sources").select("source").unionByName(self._all(segments, "gone").select("source")).distinct()
            self._told[held] = names.groupBy(F.xxhash64("source").alias("_key")).count().where("count > 1").isEmpty()
        return self._told[held]

    def index(self, version: int | None = None) -> Index:
        """A version as an index; no table is counted or copied.

        A term filter on its postings passes below the join with replaced sources into each segment's scan.
        """
        segments, head = self.listed(version), self.head(version)
        n, terms = (head["live_chunks"], head["live_terms"]) if head else (0, 0)
        columns = lambda name: [f.strip().split(" ")[0] for f in SCHEMAS[name].split(", ")]
        tables = {name: self.live(segments, name).select(*columns(name)) for name in ("chunks", "postings", "sources")}
        return Index(tables["chunks"], tables["postings"], self.tokenizer, (n, terms / n if n else 0.0), tables["sources"], self._blocks(segments))

    def _blocks(self, segments: list) -> DataFrame | None:
        """The bounds of all segments; None where a later segment has replaced rows that they count."""
        if not segments or any(s["gone"] for s in segments[1:]):
            return None
        return functools.reduce(DataFrame.unionByName, [self._table(s["segment"], "blocks") for s in segments if s["postings"]] or [self.spark.createDataFrame([], BOUNDS)])

    def vectors(self, version: int | None = None) -> DataFrame | None:
        """The live vectors, if every segment with chunks has them."""
        segments = self.listed(version)
        if not segments or any(s["chunks"] and not s["vectors"] for s in segments):
            return None
        return self.live(segments, "vectors")

    # Writing.

    def publish(self, chunks: DataFrame | None, gone: DataFrame, after: int | None = None, applied: dict[str, int] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, beside: Callable[[str], None] | None = None) -> int:
        """A version with these chunks in place of all that the sources ``gone`` had; its number.

        ``after`` is the version that the writer has read (see ``Store``);
        ``applied`` marks streams and the last of their batches that the version
        holds; ``embed`` gives vectors to the segment's chunks; ``beside(folder)``
        writes further tables of the version.
        """
        before = self.version() if after is None else after
        segments, head = self.listed(before), self.head(before)
        name = uuid.uuid4().hex
        place = segments[-1]["place"] + 1 if segments else 0
        made = self._write(name, place, 0, chunks, gone, embed)
        lost = self.live(segments, "sources").join(self._table(name, "gone"), "source", "left_semi").agg(F.sum("chunks"), F.sum("terms")).first() if segments and made[6] else (0, 0)
        won = self._table(name, "sources").agg(F.sum("chunks"), F.sum("terms"), F.max("seq")).first()
        counts = [(head[k] if head else 0) - (lost[i] or 0) + (won[i] or 0) for i, k in enumerate(("live_chunks", "live_terms"))]
        last = max(x for x in (won[2], head["last_seq"] if head else None, -1) if x is not None)
        marks = {**((head["applied"] or {}) if head else {}), **(applied or {})}
        # A batch that brings and takes nothing leaves only its marks.
        tail = self._merged([*map(tuple, segments), *([made] if made[3] or made[6] else [])])

        def write(folder: str) -> None:
            self.spark.createDataFrame(tail, LISTED).coalesce(1).write.parquet(f"{folder}/segments")
            self.spark.createDataFrame([(*counts, last, marks)], HEAD).coalesce(1).write.parquet(f"{folder}/head")
            if beside:
                beside(folder)

        number = self.store.publish(write, before)
        self._sweep()
        return number

    def size_bytes(self) -> int:
        """Bytes of the newest version's segments."""
        return sum(self.store.bytes(f"segments/{s['segment']}") for s in self.listed())

    def next_seq(self) -> int:
        """The number that comes after those of all documents so far."""
        head = self.head()
        return 0 if head is None else head["last_seq"] + 1

    def _write(self, name: str, place: int, level: int, chunks: DataFrame | None, gone: DataFrame, embed: Callable[[DataFrame], DataFrame] | None) -> tuple:
        """Write one segment; its row of the list."""
        home = f"{self.path}/segments/{name}"
        if chunks is None:
            chunks = self.spark.createDataFrame([], CHUNKS)
        Index(chunks, tokenizer=self.tokenizer).save(home, totals=False)
        gone.select("source").distinct().write.mode("overwrite").options(**ZSTD).parquet(f"{home}/gone")
        if embed:
            embed(self._table(name, "chunks")).write.mode("overwrite").parquet(f"{home}/vectors")
        return self._row(name, place, level, bool(embed))

    def _row(self, name: str, place: int, level: int, vectors: bool) -> tuple:
        """Its counts add up in the small tables; chunks and postings are not read."""
        one = self._table(name, "sources").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("b"))
        rows = one.unionByName(self._table(name, "blocks").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a"), F.lit(-1).cast("long").alias("b")))
        rows = rows.unionByName(self._table(name, "gone").agg(F.count(F.lit(1)).alias("a"), F.lit(-2).cast("long").alias("b")))
        found = {min(r["b"], 0): (r["a"], r["b"]) for r in rows.collect()}
        return (name, place, level, found[0][0], found[-1][0], found[0][1], found[-2][0], vectors)

    def _merged(self, rows: list[tuple]) -> list[tuple]:
        """The list after merging; levels fall from old to new, so what is merged is always the newest part."""
        while len(rows) >= self.fanout and len({r[2] for r in rows[-self.fanout :]}) == 1:
            old, parts = rows[: -self.fanout], rows[-self.fanout :]
            named = [dict(zip([f.split(" ")[0] for f in LISTED.split(", ")], r, strict=True)) for r in parts]
            name, kept = uuid.uuid4().hex, all(r[-1] or not r[3] for r in parts)
            home = f"{self.path}/segments/{name}"
            for table in ("chunks", "sources", *(["vectors"] if kept else [])):
                self.live(named, table).write.options(**ZSTD).parquet(f"{home}/{table}")
            write_postings(packed(self.live(named, "postings")), home)
            needed = self._all(named, "gone").select("source").distinct()
            (needed if old else needed.limit(0)).write.parquet(f"{home}/gone")
            rows = [*old, self._row(name, parts[-1][1], parts[0][2] + 1, kept)]
        return rows

    def _sweep(self) -> None:
        """Delete segments that no kept version lists and that are older than the newest version."""
        used = {s["segment"] for v in self.store.versions() for s in self.listed(v)}
        self.store.remove("segments", lambda name: name not in used)
