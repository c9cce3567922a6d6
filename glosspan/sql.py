"""The engine's operators in SQL: chunkers and searches as table functions.

    register(spark, index)
    SELECT * FROM sentence_chunks(TABLE(docs), 200, 40)
    SELECT * FROM search('container image', 5)

Chunkers take a table with ``source`` and ``text``; its other columns, but
``type`` and ``page_offsets``, come out beside the chunk.  Any partitioning will
do, as each row is a document: ``TABLE(docs) PARTITION BY (source)`` is allowed.
Searches read the index that was registered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from glosspan.functions.stopwords import STOPWORDS
from glosspan.functions.text import TOKEN
from glosspan.operators import chunking
from glosspan.operators.index import Index

MADE = [("id", StringType()), ("source", StringType()), ("text", StringType()), ("position", IntegerType()), ("first_page", IntegerType()), ("last_page", IntegerType()), ("section", StringType())]
OWN = {name for name, _ in MADE} | {"type", "page_offsets"}


def _number(given: AnalyzeArgument | None, default: int, name: str) -> int:
    if given is None:
        return default
    if given.value is None or not given.isConstantExpression:
        raise ValueError(f"{name} must be a constant number")
    return int(given.value)


def chunker(body: str, headings: bool) -> type:
    """A table function that cuts each document of a table."""

    class Chunks:
        @staticmethod
        def analyze(docs: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not docs.isTable or not {"source", "text"} <= set(docs.dataType.fieldNames()):
                raise ValueError("the first argument is a table with source and text")
            chunking.checked(_number(size, chunking.SIZE, "size"), _number(overlap, chunking.OVERLAP, "overlap"))
            others = [f for f in docs.dataType.fields if f.name not in OWN]
            return AnalyzeResult(StructType([StructField(n, t) for n, t in MADE] + others))

        def eval(self, docs: Row, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
            row = docs.asDict()
            others = [row[c] for c in row if c not in OWN]
            start = hashlib.sha1((row["source"] or "").encode()).hexdigest()[:10]
            for place, (section, text, first, last) in enumerate(chunking.cut(row["text"] or "", row.get("page_offsets"), size, overlap, body, headings)):
                yield (f"{start}-{place}", row["source"], text, place, first, last, section, *others)

    return Chunks


CHUNKERS = {"window_chunks": ("window", False), "sentence_chunks": ("sentence", False), "section_chunks": ("window", True)}

_WORDS = f"filter(transform(regexp_extract_all(query, r'{TOKEN}', 0), w -> lower(w)), w -> NOT array_contains(array({', '.join(repr(w) for w in sorted(STOPWORDS))}), w))"
_SHARES = """
  WITH asked AS (SELECT term, count(*) AS times FROM (SELECT explode({words}) AS term) GROUP BY term),
  hits AS (SELECT p.* FROM {postings} p LEFT SEMI JOIN asked USING (term)),
  df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
  shares AS (SELECT id, source, seq, position, term, times * ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * 2.5D / (tf + 1.5D * (0.25D + 0.75D * length / average)) AS share
             FROM hits JOIN asked USING (term) JOIN df USING (term) CROSS JOIN {totals}),
  best AS (SELECT id, source, seq, position, sum(share) AS score, array_sort(collect_list(struct(-share AS minus, term))) AS parts FROM shares GROUP BY id, source, seq, position),
  ranks AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, seq, position) AS rank FROM best)"""


def register(spark: SparkSession, index: Index | None = None, prefix: str = "glosspan") -> None:
    """Chunkers as table functions of the session; with an index, also ``search(query, k)`` and ``explain_search(query, k)``."""
    for name, how in CHUNKERS.items():
        spark.udtf.register(name, udtf(chunker(*how)))
    if index is None:
        return
    n, average = index.totals()
    index.postings.createOrReplaceTempView(f"{prefix}_postings")
    index.chunks.createOrReplaceTempView(f"{prefix}_chunks")
    spark.createDataFrame([(float(n), average or 1.0)], "n double, average double").createOrReplaceTempView(f"{prefix}_totals")
    shares = _SHARES.format(words=_WORDS, postings=f"{prefix}_postings", totals=f"{prefix}_totals")
    # A limit must be a constant in SQL, an argument is none: ranks are compared.
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search(query STRING, k INT DEFAULT 5) RETURNS TABLE (rank INT, id STRING, source STRING, position INT, score DOUBLE)
      RETURN {shares} SELECT rank, id, source, position, score FROM ranks WHERE rank <= k""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION explain_search(query STRING, k INT DEFAULT 5) RETURNS TABLE (rank INT, id STRING, place INT, term STRING, share DOUBLE)
      RETURN {shares} SELECT rank, id, place, part.term AS term, -part.minus AS share FROM ranks LATERAL VIEW posexplode(parts) AS place, part WHERE rank <= k""")
