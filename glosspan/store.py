"""Versioned folders of tables on any file system that Spark reaches.

A version is written beside the others and then takes its name in one rename,
so a reader never sees half of a write, and a writer that breaks off leaves the
newest version as it was.  The version before the newest stays for readers that
have it open.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published a version in the meantime."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, folder = self._at()
        if not fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(folder))
        return sorted(int(name[1:]) for name in names if name[:1] == "v" and name[1:].isdigit())

    def newest(self) -> str | None:
        """The folder of the newest version."""
        found = self.versions()
        return f"{self.path}/v{found[-1]}" if found else None

    def has(self, folder: str, name: str) -> bool:
        fs, path = self._at()
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))

    def publish(self, write: Callable[[str], None], after: int | None = None) -> int:
        """Write the next version with ``write(folder)`` and name it; its number.

        ``after`` is the version that the writer has read: a newer one by
        another writer is a conflict, and nothing is published.
        """
        draft = f"draft-{uuid.uuid4().hex}"
        write(f"{self.path}/{draft}")
        found = self.versions()
        number = (found[-1] if found else 0) + 1
        fs, source = self._at(draft)
        _, target = self._at(f"v{number}")
        if (after is not None and number != after + 1) or fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            raise Conflict(f"{self.path}: version {number - 1} is not the one that was read")
        for old in found[:-1]:
            fs.delete(self._at(f"v{old}")[1], True)
        return number

    def bytes(self, folder: str) -> int:
        fs, path = self._at(folder)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def remove(self, folder: str, unused: Callable[[str], bool], older: float = 3600.0) -> None:
        """Delete what lies in a folder, is not in use and has not changed for so many seconds, in which a writer may still name it."""
        fs, path = self._at(folder)
        if fs.exists(path):
            newest = max((status.getModificationTime() for status in fs.listStatus(path)), default=0)
            for status in fs.listStatus(path):
                if unused(status.getPath().getName()) and newest - status.getModificationTime() >= older * 1000:
                    fs.delete(status.getPath(), True)
