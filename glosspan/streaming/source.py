"""Watched folders as a streaming source with offsets that can be replayed.

An offset is the number of a manifest: the files below the roots at one moment,
written as Parquet in PARTS parts by a hash of the path.  A batch is the
difference of two manifests, made part by part in tasks, so a batch that is
planned again after a stop has the same rows, whatever the folders hold by then.
Manifests before a committed one are retired.

Folders are listed through Arrow's file systems (local, HDFS, object stores);
names that begin with ``.`` or ``_`` are passed over, as Spark's file sources do.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from glosspan.operators.filters import is_ignored
from glosspan.sources.files import LOADERS

PARTS = 8
SCHEMA = "path string, kind string, mtime long, size long, version long"
_MANIFEST = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])
SUFFIXES = tuple(s for suffixes in LOADERS.values() for s in suffixes)


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what comes before that path in a source's name)."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path, ""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, "" if path.startswith("file:") else path[: path.index(inner)]


def listing(roots: Sequence[str], ignored: Sequence[str] = (), suffixes: tuple[str, ...] = SUFFIXES) -> Iterator[tuple[str, int, int]]:
    """(path, time of change in microseconds, size) of every file that a loader takes, below the roots."""
    for root in roots:
        system, inner, before = opened(root)
        if system.get_file_info(inner).type == pafs.FileType.File:
            found = [system.get_file_info(inner)]
        else:
            found = system.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
        for info in found:
            below = info.path[len(inner) :].split("/")
            if info.type == pafs.FileType.File and info.path.lower().endswith(suffixes) and not any(p[:1] in (".", "_") for p in below):
                path = before + info.path
                if not is_ignored(path, ignored, roots):
                    yield path, (info.mtime_ns or 0) // 1000, info.size


class Manifests:
    """Numbered listings below a folder."""

    def __init__(self, home: str, parts: int = PARTS):
        self.system, self.home, _ = opened(home)
        self.parts = parts

    def _names(self) -> list[str]:
        return [i.base_name for i in self.system.get_file_info(pafs.FileSelector(self.home, allow_not_found=True))]

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names() if n[:1] == "m" and n[1:].isdigit())

    def name(self) -> str:
        """What this series of manifests is called in an index that follows it; it lives and goes with the folder."""
        found = [n for n in self._names() if n.startswith("id-")]
        if not found:
            found = [f"id-{uuid.uuid4().hex}"]
            self.system.create_dir(f"{self.home}/{found[0]}", recursive=True)
        return min(found)

    def take(self, files: Iterator[tuple[str, int, int]]) -> int:
        """The number of a manifest of these files: the newest one if nothing differs from it, else a new one."""
        rows: list[list[tuple[str, int, int]]] = [[] for _ in range(self.parts)]
        digest = count = 0
        for row in set(files):
            rows[zlib.crc32(row[0].encode()) % self.parts].append(row)
            digest ^= int.from_bytes(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(row)).bytes)
            count += 1
        mark = f"{count}-{digest:x}"
        newest = max(self.versions(), default=0)
        if (self._mark(newest) if newest else "0-0") == mark:
            return newest
        draft, number = f"{self.home}/draft-{uuid.uuid4().hex}", newest + 1
        self.system.create_dir(draft, recursive=True)
        for k, part in enumerate(rows):
            pq.write_table(pa.table([list(c) for c in zip(*part, strict=True)] or [[], [], []], schema=_MANIFEST), f"{draft}/part-{k}.parquet", filesystem=self.system)
        with self.system.open_output_stream(f"{draft}/_mark") as out:
            out.write(mark.encode())
        self.system.move(draft, f"{self.home}/m{number}")
        return number

    def _mark(self, version: int) -> str:
        with self.system.open_input_stream(f"{self.home}/m{version}/_mark") as source:
            return source.read().decode()

    def read(self, version: int, part: int) -> dict[str, tuple[int, int]]:
        """The files of one part; version 0 is no files."""
        if not version:
            return {}
        table = pq.read_table(f"{self.home}/m{version}/part-{part}.parquet", filesystem=self.system)
        return dict(zip(table["path"].to_pylist(), zip(table["mtime"].to_pylist(), table["size"].to_pylist(), strict=True), strict=True))

    def difference(self, start: int, end: int, part: int) -> Iterator[tuple[str, str, int, int, int]]:
        """(path, kind, mtime, size, version) of what is new, differs or is gone."""
        before, now = self.read(start, part), self.read(end, part)
        for path, (mtime, size) in now.items():
            if before.get(path) != (mtime, size):
                yield path, "changed", mtime, size, end
        for path in before.keys() - now.keys():
            yield path, "removed", *before[path], end

    def retire(self, below: int) -> None:
        for version in self.versions():
            if version < below:
                self.system.delete_dir(f"{self.home}/m{version}")


class Part(InputPartition):
    def __init__(self, start: int, end: int, part: int):
        super().__init__((start, end, part))


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots, self.ignored = json.loads(options["roots"]), json.loads(options.get("ignored", "[]"))
        self.first = int(options.get("from", 0))
        self.manifests = Manifests(options["home"], int(options.get("parts", PARTS)))

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        return {"version": self.manifests.take(listing(self.roots, self.ignored))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Part(start["version"], end["version"], k) for k in range(self.manifests.parts)] if start != end else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.manifests.difference(*partition.value)

    def commit(self, end: dict) -> None:
        self.manifests.retire(end["version"])


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes")`` with the options roots, ignored (JSON lists), home (of the manifests) and from."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)
