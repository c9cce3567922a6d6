"""Folders of files as documents: text, Markdown, HTML, DOCX, and PDF where a reader is installed."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.functions.text import suffix
from glosspan.sources import docx, html

#: Suffixes of each loader, in the order in which loaders are asked.
LOADERS = {"markdown": (".md", ".markdown"), "text": (".txt", ".rst"), "pdf": (".pdf",), "html": (".html", ".htm", ".xhtml"), "docx": (".docx",)}
SCHEMA = "source string, text string, type string, title string, page_offsets array<int>, failed string"


class Unsupported(ValueError):
    """No loader takes the file."""


def loader(source: str | Column = "source") -> Column:
    """The loader's name; null for files that are skipped."""
    found, out = suffix(source), F.lit(None).cast("string")
    for name, suffixes in reversed(LOADERS.items()):
        out = F.when(found.isin(*suffixes), name).otherwise(out)
    return out


def plain(content: bytes) -> str:
    return re.sub(r"\r\n?", "\n", content.decode("utf-8", errors="replace"))


def pdf_pages(content: bytes) -> list[str]:
    import io

    from pypdf import PdfReader  # an optional package

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def _plain(content: bytes, name: str) -> tuple[str, str, list[int] | None]:
    return plain(content), "", None


def _html(content: bytes, name: str) -> tuple[str, str, list[int] | None]:
    page = html.whole(content.decode("utf-8", errors="replace"))
    return page.text, page.title, None


def _docx(content: bytes, name: str) -> tuple[str, str, list[int] | None]:
    return *docx.to_text(content, name), None


def paged(pages: list[str]) -> tuple[str, str, list[int] | None]:
    """Pages as one text with the offsets at which they begin."""
    return "\n\n".join(pages), "", list(itertools.accumulate((len(p) + 2 for p in pages[:-1]), initial=0)) if pages else []


def _pdf(content: bytes, name: str) -> tuple[str, str, list[int] | None]:
    return paged(pdf_pages(content))


#: By loader, what turns a file's bytes and name into (text, title, page offsets).
PARSERS: dict[str, Callable[[bytes, str], tuple[str, str, list[int] | None]]] = {"markdown": _plain, "text": _plain, "html": _html, "docx": _docx, "pdf": _pdf}


def parse(kind: str, content: bytes, name: str, parsers: dict[str, Callable] = PARSERS) -> tuple[str, str, list[int] | None]:
    """(text, title, page offsets) of a file's bytes."""
    if kind not in parsers:
        raise Unsupported(name)
    return parsers[kind](content, name)


def resolved(spark: SparkSession, path: str) -> str:
    """A path as :func:`documents` names sources: absolute, without a scheme for local files."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub("^file:/*", "/", full).rstrip("/") or "/"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of every file below ``path``.

    The content column is read only by plans that use it.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files at these paths, and no others."""
    return spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def opened(paths: DataFrame) -> DataFrame:
    """(path, content) of paths (path), read in tasks; a file that has gone in the meantime is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                try:
                    with system.open_input_stream(inner, compression=None) as source:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([source.read()], pa.binary())], ["path", "content"])
                except FileNotFoundError:
                    continue

    return paths.select("path").mapInArrow(run, "path string, content binary")


def content_of(spark: SparkSession, source: str) -> bytes | None:
    """A file's bytes; None if it has gone."""
    row = opened(spark.createDataFrame([(source,)], "path string")).first()
    return None if row is None else bytes(row["content"])


def text_of(spark: SparkSession, source: str) -> str | None:
    """A source read again; None for a URL, a kind that no loader takes, or a file that cannot be read."""
    if re.match("(?i)https?://", source):
        return None
    try:
        row = documents(read(spark, [source])).first()
    except AnalysisException:  # it is gone
        return None
    return row["text"] if row is not None and row["failed"] is None else None


def documents(files: DataFrame, parsers: dict[str, Callable] = PARSERS) -> DataFrame:
    """Parsed files; a file that cannot be parsed has its reason in ``failed``."""
    rows = files.select(F.regexp_replace("path", "^file:/*", "/").alias("source"), "content").withColumn("type", loader())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for source, content, kind in frame[["source", "content", "type"]].itertuples(index=False):
                try:
                    text, title, pages = parse(kind, bytes(content), source, parsers)
                    out.append((source, text, kind, title, pages, None))
                except Exception as error:  # noqa: BLE001  one bad file doesn't end the run
                    out.append((source, None, kind, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["source", "text", "type", "title", "page_offsets", "failed"])

    return rows.where(F.col("type").isNotNull()).mapInPandas(run, SCHEMA)


def skipped(files: DataFrame) -> DataFrame:
    """Files that no loader takes."""
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("source")).where(loader().isNull())
