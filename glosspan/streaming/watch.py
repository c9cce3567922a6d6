"""Keeping an index in step with changing folders.

A snapshot is rows (path, mtime, size).  The built-in file source reports new
files only, so changes and removals come from the difference of two snapshots;
a stream takes them from the manifests of :mod:`glosspan.streaming.source`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glosspan.operators.filters import ignored, under_path
from glosspan.operators.index import Index
from glosspan.sources import files
from glosspan.store import Conflict
from glosspan.streaming.source import FolderChanges, Manifests, listing

SNAPSHOT = "path string, mtime long, size long"


def snapshot(spark: SparkSession, *roots: str) -> DataFrame:
    """The files below the roots; contents are not read."""
    out = spark.createDataFrame([], SNAPSHOT)
    for root in roots:
        found = files.listed(spark, root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"))
        out = out.unionByName(found)
    return out


def difference(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, kind): changed (new or with another time or size) or removed."""
    a = before.select("path", F.struct("mtime", "size").alias("old"))
    b = now.select("path", F.struct("mtime", "size").alias("new"))
    met = a.join(b, "path", "full_outer")
    kind = F.when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return met.select("path", kind.alias("kind")).where(F.col("kind").isNotNull())


def applied(index: Index, changes: DataFrame, read: Callable[[DataFrame], DataFrame], indexed_at: str = "", **options) -> Index:
    """The index after a batch of changes: changed files are indexed anew, removed ones go."""
    gone = changes.where("kind = 'removed'").select(F.col("path").alias("source"))
    fresh = read(changes.where("kind = 'changed'").select("path"))
    index = index.add(fresh, indexed_at=indexed_at, **options)
    return index.without(gone)


class Watcher:
    """Applies the changes of watched folders to an index, each once.

    The folders' manifests and the stream's checkpoint lie beside the index,
    under a name made of roots and ignored folders, so a watch that is started
    again goes on where it stopped.  A published version of the index holds the
    number of the manifest it stands for; a batch that is delivered again after
    a stop finds its number there and changes nothing.  A version by another
    writer in the meantime is a conflict, and the batch is done again on top of
    it.
    """

    TRIES = 5

    def __init__(self, engine, *roots: str, ignored: list[str] | None = None, after: Callable[[DataFrame], None] | None = None):
        self.engine, self.spark, self.after = engine, engine.spark, after
        self.roots = [files.resolved(self.spark, r) for r in roots]
        self.ignored = [files.resolved(self.spark, f) for f in ignored or []]
        named = hashlib.sha256(json.dumps([self.roots, self.ignored]).encode()).hexdigest()[:16]
        self.home = f"{files.resolved(self.spark, engine.store.path)}/watch-{named}"
        self.manifests = Manifests(f"{self.home}/manifests")
        self.name = f"watch {', '.join(self.roots)}"

    def applied(self) -> int:
        """The manifest that the index stands for; 0 if it has followed none of this series."""
        head = self.engine.segments.head()
        return (head["applied"] or {}).get(self.manifests.name(), 0) if head else 0

    def _gone(self, version: int) -> DataFrame:
        """Indexed files below the roots that a manifest lacks: what went before the first watch."""
        below = F.lit(False)
        for root in self.roots:
            below = below | under_path(root)
        known = self.engine.index().sources().where(below & ~ignored("source", self.ignored, self.roots)).select(F.col("source").alias("path"))
        now = self.spark.read.schema(SNAPSHOT).parquet(f"{self.home}/manifests/m{version}") if version else self.spark.createDataFrame([], SNAPSHOT)
        return known.join(now, "path", "left_anti").select("path", F.lit("removed").alias("kind"))

    def apply(self, changes: DataFrame, version: int) -> int:
        """Apply the changes that lead to a manifest, unless the index stands for it already; how many documents change."""
        for left in reversed(range(self.TRIES)):
            before = self.applied()
            if before >= version:
                return 0
            todo = changes.select("path", "kind")
            if not before:
                todo = todo.unionByName(self._gone(version))
            todo = todo.persist()
            try:
                count = self.engine.apply(todo, {self.manifests.name(): version})
                if count and self.after:
                    self.after(todo)
                return count
            except Conflict:
                if not left:
                    raise
            finally:
                todo.unpersist()
        return 0

    def poll(self) -> int:
        """One round without a stream; how many documents change."""
        before, now = self.applied(), self.manifests.take(listing(self.roots, self.ignored))
        if before == now:
            return 0
        read = lambda v: self.spark.read.schema(SNAPSHOT).parquet(f"{self.home}/manifests/m{v}") if v else self.spark.createDataFrame([], SNAPSHOT)
        count = self.apply(difference(read(before), read(now)), now)
        self.manifests.retire(now)
        return count

    def _batch(self, changes: DataFrame, number: int) -> None:
        version = changes.agg(F.max("version")).first()[0]
        if version:
            self.apply(changes, version)

    def start(self, interval: str = "1 second") -> StreamingQuery:
        """Follow the folders from the manifest that the index stands for; an error ends the stream."""
        self.spark.dataSource.register(FolderChanges)
        series = self.manifests.name()
        options = {"roots": json.dumps(self.roots), "ignored": json.dumps(self.ignored), "home": f"{self.home}/manifests", "from": str(self.applied())}
        changes = self.spark.readStream.format(FolderChanges.name()).options(**options).load()
        return changes.writeStream.queryName(self.name).option("checkpointLocation", f"{self.home}/{series}").trigger(processingTime=interval).foreachBatch(self._batch).start()
