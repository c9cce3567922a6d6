"""Where passages stand in their documents, all of a document in one pass.

A passage is a sequence of words; in a document it may have any white space
between them, and its first and last word may be the end and the beginning of
longer ones, unless whole words are asked for.  A document's words get rolling hashes of all runs of the lengths
its passages ask for, so a passage is looked up by the hash of the words between
its first and its last, verified word by word, and placed by the code points at
which its words begin and end.  The work is linear in the text and its passages,
where a search for each passage walks over the whole text again.

Passages of one document travel in groups of GROUP, each with its text.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspan.session import small_batches

GROUP = 4096
#: Base of the rolling hash, odd; arithmetic is modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)])


def _codes(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    # Two checksums in one number; words that share it are told apart when they are compared.
    codes = np.array([zlib.crc32(w.encode()) | zlib.adler32(w.encode()) << 32 for w in known] or [0], np.uint64)
    return codes[at] if len(words) else np.empty(0, np.uint64)


class Words:
    """A text's words with their places and the hashes of their runs."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in re.finditer(r"\S+", text)]
        self.spans, self.words = found, [text[a:b] for a, b in found]
        n = len(found)
        self.power = _powers(n)
        # ahead[i] is the sum of code[j] * BASE**j for j < i, so a run's hash is a difference, shifted to the end.
        self.ahead = np.concatenate([[np.uint64(0)], np.cumsum(_codes(self.words) * self.power[:n], dtype=np.uint64)])
        self.runs: dict[int, dict[int, list[int]]] = {}

    def places(self, n: int, key: int) -> list[int]:
        """Where runs of n words with this hash begin, in order."""
        if n not in self.runs:
            size = len(self.words)
            hashes = (self.ahead[n:] - self.ahead[: size + 1 - n]) * self.power[size + 1 - n - 1 :: -1][: size + 1 - n] if size >= n else np.empty(0, np.uint64)
            at: dict[int, list[int]] = defaultdict(list)
            for i, h in enumerate(hashes.tolist()):
                at[h].append(i)
            self.runs[n] = at
        return self.runs[n].get(key, [])

    def key(self, words: list[str]) -> int:
        """The hash that a run of these words has in this text."""
        n, size = len(words), len(self.words)
        own = int(np.sum(_codes(words) * self.power[:n], dtype=np.uint64))
        return own * int(self.power[size - n]) % (1 << 64) if n <= size else -1

    def first(self, passage: str, whole: bool = False) -> tuple[int, int] | None:
        """(start, end) of the passage where it first stands, in code points; ``whole``: only between whole words."""
        words = passage.split()
        if whole:
            n = len(words)
            for i in self.places(n, self.key(words)) if words else ():
                if self.words[i : i + n] == words:
                    return self.spans[i][0], self.spans[i + n - 1][1]
            return None
        if len(words) < 3:
            found = re.search(r"\s+".join(map(re.escape, words)), self.text) if words else None
            return found.span() if found else None
        inner = words[1:-1]
        n = len(inner)
        for i in self.places(n, self.key(inner)):
            if i and i + n < len(self.words) and self.words[i - 1].endswith(words[0]) and self.words[i + n].startswith(words[-1]) and self.words[i : i + n] == inner:
                return self.spans[i - 1][1] - len(words[0]), self.spans[i + n][0] + len(words[-1])
        return None


def located(documents: DataFrame, passages: DataFrame, whole: bool = False) -> DataFrame:
    """Passages (source, passage, and further columns) with start and end, null where they don't stand in their document (source, text).

    ``whole``: the first and the last word are whole words of the document, as those of its chunks are.

    ``source`` names one document; passages of unknown sources are left out.
    """
    small_batches(documents.sparkSession)
    keys = [c for c in passages.columns if c != "source"]
    counts = passages.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    groups = F.ceil(F.col("_n") / GROUP)
    texts = documents.select("source", "text").join(counts, "source").select("source", "text", F.explode(F.sequence(F.lit(0), (groups - 1).cast("int"))).alias("_group"))
    dealt = passages.join(counts, "source").withColumn("_group", F.pmod(F.xxhash64(*keys), groups).cast("int"))
    held = dealt.groupBy("source", "_group").agg(F.collect_list(F.struct(*keys)).alias("asked"))
    rows = texts.join(held, ["source", "_group"]).select("source", "text", "asked", F.transform("asked", lambda a: a["passage"]).alias("passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = Words(text or "")
                known: dict[str, tuple[int, int] | None] = {}
                spans.append([known[p] if p in known else known.setdefault(p, words.first(p or "", whole)) for p in wanted])
            made = pa.array([[None if s is None else {"start": s[0], "end": s[1]} for s in row] for row in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), made], ["source", "asked", "spans"])

    asked = rows.schema["asked"].dataType.simpleString()
    sent = rows.select("source", "text", "passages", "asked")
    found = sent.mapInArrow(run, f"source string, asked {asked}, spans array<struct<start:int,end:int>>")
    each = found.select("source", F.explode(F.arrays_zip("asked", "spans")).alias("z"))
    return each.select("source", *[F.col("z.asked").getField(c).alias(c) for c in keys], F.col("z.spans.start").alias("start"), F.col("z.spans.end").alias("end"))
