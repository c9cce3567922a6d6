"""Documents to chunks: sliding windows, packed sentences, Markdown sections.

A document row has ``source, text`` and optionally ``type`` and ``page_offsets``
(array<int>).  A chunk row has ``id, source, text, position, first_page,
last_page, section``.  Windows are Column expressions; sentences and Markdown
carry state from word to word, so they are an Arrow-batched function per
document.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspan.functions.text import WORD, chunk_id, page_at, running, words
from glosspan.session import small_batches

SIZE, OVERLAP = 200, 40
CHUNK_COLUMNS = ["id", "source", "text", "position", "first_page", "last_page", "section"]
#: Types whose text has headings.
WITH_HEADINGS = ("markdown", "html", "docx")


def checked(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")


def windows(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` words, each ``overlap`` words into the one before."""
    checked(size, overlap)
    step = size - overlap
    paged = "page_offsets" in documents.columns
    keep = [c for c in documents.columns if c not in ("text", "page_offsets")]
    rows = documents.select(*keep, *(["page_offsets"] if paged else []), "text", words("text").alias("words"))
    count = F.size("words")
    n = F.when(count == 0, 0).when(count <= size, 1).otherwise(1 + F.ceil((count - size) / F.lit(step)))
    if paged:
        # Offsets of the words: running lengths of alternating gaps and words.
        rows = rows.withColumn("offsets", word_offsets("text", "words"))
    # No filter on the words: it would be pushed down and find them all once more.
    rows = rows.withColumn("position", F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int")))))
    begin = F.col("position") * step
    text = F.array_join(F.slice("words", begin + 1, size), " ")
    if paged:
        last = F.least(begin + size, F.size("words"))
        pages = [page_at("page_offsets", F.element_at("offsets", begin + 1)).alias("first_page"), page_at("page_offsets", F.element_at("offsets", last)).alias("last_page")]
    else:
        pages = [F.lit(None).cast("int").alias("first_page"), F.lit(None).cast("int").alias("last_page")]
    others = [c for c in keep if c != "source"]
    return rows.select(chunk_id("source", "position").alias("id"), "source", text.alias("text"), "position", *pages, F.lit("").alias("section"), *others)


def word_offsets(text: str, found: str):
    """Code-point offset of each word."""
    gaps = F.split(F.col(text), WORD)
    # Between the starts of two words are the first of them and the gap.
    before = F.concat(F.array(F.lit(0)), F.transform(F.col(found), F.char_length))
    return running(F.zip_with(F.slice(gaps, 1, F.size(found)), F.slice(before, 1, F.size(found)), lambda g, w: F.char_length(g) + w))


# Fixed values that decide where a sentence ends.
ENDS = (".", "!", "?", "…")
CLOSING = "\"')]}»”’*_"
OPENING = "\"'([{«“‘*_"
ABBREVIATIONS = frozenset("e.g i.e etc vs cf al fig no p pp mr mrs ms dr prof sr sra st jr approx ex".split())

Word = tuple[int, int]


def borders(text: str, found: list[Word]) -> np.ndarray:
    """The numbers of the words that end a sentence, found from what each word is and what follows it.

    A word closes one where a blank line follows it, or where it carries an end
    mark (closing signs after it don't count), is no abbreviation, and the next
    word does not go on in lower case.
    """
    n = len(found)
    if n < 2:
        return np.empty(0, np.int64)
    written = [text[a:b] for a, b in found]
    stems = [w.rstrip(CLOSING) for w in written]
    marked = np.fromiter((s.endswith(ENDS) for s in stems), bool, n)
    short = np.fromiter((m and s.rstrip(".").lower() in ABBREVIATIONS for m, s in zip(marked, stems, strict=True)), bool, n)
    lower = np.fromiter((w.lstrip(OPENING)[:1].islower() for w in written), bool, n)
    blank = np.zeros(n, bool)
    gaps = np.array(found)
    for k in np.flatnonzero(gaps[1:, 0] - gaps[:-1, 1] > 1).tolist():
        between = text[found[k][1] : found[k + 1][0]].split("\n")[1:-1]
        blank[k] = any(not line.removesuffix("\r").strip(" \t") for line in between)
    return np.flatnonzero((blank | (marked & ~short & ~np.append(lower[1:], False)))[:-1])


def sentences(text: str) -> list[list[Word]]:
    """Words (start, end) by sentence."""
    found = [m.span() for m in re.finditer(r"\S+", text)]
    cuts = [0, *(borders(text, found) + 1).tolist(), len(found)]
    return [found[a:b] for a, b in itertools.pairwise(cuts) if a < b]


def packed(text: str, size: int, overlap: int) -> list[list[Word]]:
    """Chunks of whole sentences of at most ``size`` words; longer sentences are cut first.

    A chunk begins with the sentences that close the one before it, as many as
    ``overlap`` words hold, but always later than that one began.
    """
    found = [m.span() for m in re.finditer(r"\S+", text)]
    ends = np.concatenate([borders(text, found) + 1, [len(found)]])
    begins = np.concatenate([[0], ends[:-1]])
    # Where units begin, counted in words: sentences, and every ``size`` words within one.
    edges = np.unique(np.concatenate([np.arange(a, b, size) for a, b in zip(begins, ends, strict=True)] + [[len(found)]])).astype(np.int64)
    chunks, at = [], 0
    while at < len(edges) - 1:
        stop = int(np.searchsorted(edges, edges[at] + size, "right")) - 1
        chunks.append(found[edges[at] : edges[stop]])
        if stop == len(edges) - 1:
            break
        at = max(at + 1, int(np.searchsorted(edges, edges[stop] - overlap, "left")))
    return chunks


def heading(line: str) -> tuple[int, str] | None:
    """(level, title) of a line that is a heading: up to three blanks, one to six signs, a gap, a title, perhaps closing signs."""
    bare = line.lstrip(" ")
    level = len(bare) - len(bare.lstrip("#"))
    title = bare[level:].strip(" \t")
    if len(line) - len(bare) > 3 or not 1 <= level <= 6 or not title or bare[level] not in " \t":
        return None
    open_part = title.rstrip("#")
    return level, open_part.rstrip(" \t") if open_part != title and open_part.endswith((" ", "\t")) else title


def fenced(lines: list[str]) -> np.ndarray:
    """Which lines lie in a fence, its ends included; a fence ends at the next mark of its own kind, or never."""
    marks = [(i, mark) for i, line in enumerate(lines) if (mark := line.strip()[:3]) in ("```", "~~~")]
    out, free = np.zeros(len(lines), bool), 0
    for i, mark in marks:
        if i >= free:
            free = next((j for j, other in marks if j > i and other == mark), len(lines) - 1) + 1
            out[i:free] = True
    return out


def sections(text: str) -> list[tuple[str, str]]:
    """(heading path, text) of Markdown sections that hold more than their heading.

    Headings are lines of a level; the path of one is that of the last heading
    before it with a lower level, and its own title.
    """
    lines = text.splitlines()
    inside = fenced(lines)
    found = [(i, *h) for i, line in enumerate(lines) if not inside[i] and (h := heading(line))]
    paths: list[str] = []
    above: list[int] = []
    for k, (_, level, title) in enumerate(found):
        up = k - 1
        while up >= 0 and found[up][1] >= level:
            up = above[up]
        above.append(up)
        paths.append(f"{paths[up]} > {title}" if up >= 0 else title)
    filled = np.concatenate([[0], np.cumsum([bool(line.strip()) for line in lines])])
    bounds = [i for i, *_ in found] + [len(lines)]
    runs = [("", 0, bounds[0], filled[bounds[0]])]
    runs += [(path, a, b, filled[b] - filled[a + 1]) for path, (a, b) in zip(paths, itertools.pairwise(bounds), strict=True)]
    return [(path, "\n".join(lines[a:b])) for path, a, b, more in runs if more]


def _page(offsets, at: int) -> int | None:
    return max(1, sum(o <= at for o in offsets)) if offsets is not None and len(offsets) else None


def _pieces(text: str, offsets, body: str, size: int, overlap: int) -> Iterator[tuple[str, int | None, int | None]]:
    if body == "sentence":
        groups = packed(text, size, overlap)
    else:
        found = [m.span() for m in re.finditer(r"\S+", text)]
        groups = [found[i : i + size] for i in range(0, max(1, len(found) - overlap), size - overlap)] if found else []
    for group in groups:
        yield " ".join(text[a:b] for a, b in group), _page(offsets, group[0][0]), _page(offsets, group[-1][0])


def cut(text: str, offsets, size: int, overlap: int, body: str, headings: bool) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(section, text, first page, last page) of a document's chunks, in order."""
    for section, part in sections(text) if headings else [("", text)]:
        for piece in _pieces(part, None if headings else offsets, body, size, overlap):
            yield section, *piece


def _mapped(documents: DataFrame, size: int, overlap: int, body: str, headings: bool) -> DataFrame:
    checked(size, overlap)
    small_batches(documents.sparkSession)
    keep = [c for c in documents.columns if c not in ("source", "text", "page_offsets")]
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    schema = "source string, text string, position int, first_page int, last_page int, section string" + (f", {fields}" if fields else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                pieces = cut(row["text"] or "", row.get("page_offsets"), size, overlap, body, headings)
                rows += [(row["source"], t, i, a, b, section, *(row[c] for c in keep)) for i, (section, t, a, b) in enumerate(pieces)]
            out = pd.DataFrame(rows, columns=["source", "text", "position", "first_page", "last_page", "section", *keep])
            yield out.astype({"first_page": "Int32", "last_page": "Int32"})

    made = documents.mapInPandas(run, schema)
    return made.select(chunk_id("source", "position").alias("id"), "source", "text", "position", "first_page", "last_page", "section", *keep)


def packed_sentences(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return _mapped(documents, size, overlap, "sentence", False)


def markdown(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, body: str = "window") -> DataFrame:
    """Sections, each cut by the body chunker; positions run through the document."""
    return _mapped(documents, size, overlap, body, True)


def by_type(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, body: str = "window") -> DataFrame:
    """Documents with headings by section, the others by the body chunker."""
    headed = F.coalesce(F.col("type").isin(*WITH_HEADINGS), F.lit(False))
    plain = windows if body == "window" else packed_sentences
    rest = plain(documents.where(~headed), size, overlap)
    return markdown(documents.where(headed), size, overlap, body).select(rest.columns).unionByName(rest)
