"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``window`` words (an item with fewer words is
one window).  A window is a set of word shingles at known offsets; a document
contains the window only if it contains every one of them at those offsets, so
the window's rarest shingle is a sufficient prefix.  The plan:

1. *Tokens*: the shingles of all documents that occur in any item (one pass
   over the documents, an equi-join with the items' shingle dictionary).
2. *Rarity*: occurrences of each shingle over all documents; windows with a
   shingle that never occurs are out.
3. *Prefix join*: occurrences of each window's rarest shingle give a start;
   starts outside the document are out (positional and length bounds).
4. *Verification*: shingles that together cover every word of the window must
   stand at their offsets; they are joined as words, so a match is exact.

The dictionary is broadcast where its counted size allows it, else joined by
sort-merge behind a bit map of its keys, which spares the shuffle nearly all
shingles of the documents.  A passage found in a third of all documents only adds rows to the
partially aggregated counts and to joins that Spark may split.

Defined results: null text or null item text has no words; items of no words
match nothing; rows that repeat a doc_id with the same text get the same
result; a null doc_id is one like any other; an item with a null id counts as
one with the id ''; an empty table of documents gives an empty result, one of
items contaminates nothing; columns other than doc_id and text, whatever their
names, are only carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.common import ascii_lower, lookup, staged, table, text_or_empty

WINDOW = 10
SHINGLE = 5
#: What separates words once A-Z is lower case: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc_id", "tk"]


def words(column="text") -> Column:
    return F.array_remove(F.split(ascii_lower(text_or_empty(column)), SEPARATORS), "")


def shingles(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, pos (from 0) and s, the k words from there, for rows with ``words`` and ``n``."""
    shifted = [F.slice("words", i + 1, F.greatest(F.col("n") - (k - 1), F.lit(0))).alias(f"w{i}") for i in range(k)]
    zipped = rows.where(F.col("n") >= k).select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "at"))
    return zipped.select(*keys, "pos", F.concat_ws(" ", *[F.col(f"at.w{i}") for i in range(k)]).alias("s"))


def windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(item_id, w) and the distinct windows (w, length, shingle)."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words().alias("words")).withColumn("n", F.size("words")).where("n > 0")
    length = F.least(F.col("n"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.col("n") - length + 1)).alias("start")
    cut = split.select("item_id", "words", length.alias("length"), starts)
    cut = staged(cut.select("item_id", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("w"), "length").distinct(), "windows")
    return cut.select("item_id", "w"), cut.select("w", "length").distinct()


def parts_of(distinct: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Each window's shingles: w, length, k, pos, s, and whether s is needed to cover the words."""
    cut = distinct.select("w", "length", F.least("length", F.lit(shingle)).alias("k"), F.split("w", " ").alias("words"))
    cut = cut.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("k"))))
    covers = (F.col("pos") % F.col("k") == 0) | (F.col("pos") == F.col("length") - F.col("k"))
    return cut.select("w", "length", "k", "pos", F.array_join(F.slice("words", F.col("pos") + 1, F.col("k")), " ").alias("s"), covers.alias("covers"))


def occurrences(docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Exact occurrences of windows: doc_id, tk (hash of the text), w, start, length."""
    needed = staged(parts_of(distinct, shingle), "shingles")
    known = staged(needed.select("k", "s").distinct(), "dictionary")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tk"), words().alias("words")).withColumn("n", F.size("words"))
    found = None
    for (k,) in sorted(known.select("k").distinct().collect()):  # at most ``shingle`` values
        here = lookup(shingles(rows, [*DOC, "n"], k), known.where(F.col("k") == k).select("s"), ["s"], row_bytes=256)
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = rows.select(*DOC, "n", F.lit(0).alias("pos"), F.lit("").alias("s")).limit(0)
    found = staged(found, "tokens")
    rarity = found.groupBy("s").count()
    scored = needed.join(rarity, "s", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = scored.groupBy("w", "length").agg(F.min(F.struct("count", "pos", "s")).alias("first"), F.collect_list(F.when(F.col("covers"), F.struct("pos", "s"))).alias("cover"))
    rarest = staged(rarest.where("first.count > 0").select("w", "length", F.col("first.pos").alias("offset"), F.col("first.s").alias("s"), "cover"), "prefixes")
    begun = lookup(found, rarest, ["s"], row_bytes=1024).withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0 AND start + length <= n")
    asked = begun.select(*DOC, "w", "start", "length", F.size("cover").alias("wanted"), F.explode("cover").alias("c")).select(*DOC, "w", "start", "length", "wanted", (F.col("start") + F.col("c.pos")).alias("pos"), F.col("c.s").alias("s"))
    there = found.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.col("pos").alias("_pos"), F.col("s").alias("_s"))
    met = asked.join(there.hint("merge"), asked["doc_id"].eqNullSafe(there["_id"]) & (asked["tk"] == there["_tk"]) & (asked["pos"] == there["_pos"]) & (asked["s"] == there["_s"]), "left_semi")
    met = met.distinct().groupBy(*DOC, "w", "start", "length", "wanted").count()
    return staged(met.where(F.col("count") == F.col("wanted")).select(*DOC, "w", "start", "length"), "occurrences")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return verdicts(docs.select("doc_id", F.xxhash64("text").alias("tk"), F.size(words()).cast("long").alias("n_words")), docs, items, window, shingle)


def verdicts(rows: DataFrame, docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    of_item, distinct = windows(items, window)
    met = occurrences(docs, distinct, shingle)
    hit = met.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("p")).distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    named = lookup(met.select(*DOC, "w").distinct(), of_item, ["w"], row_bytes=256).select(*DOC, "item_id").distinct()
    named = named.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    both = hit.alias("h").join(named.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h.tk = i.tk")).select(F.col("h.doc_id").alias("_id"), F.col("h.tk").alias("_tk"), "n_hit", "n_items", F.col("items_sha256").alias("_sha"))
    out = rows.join(both, rows["doc_id"].eqNullSafe(both["_id"]) & (rows["tk"] == both["_tk"]), "left")
    return out.select(
        *[c for c in rows.columns if c != "tk"],
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that contain no window of any item."""
    met = occurrences(docs, windows(items, window)[1]).select(*DOC).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("tk"))
    return rows.alias("r").join(met.alias("m"), F.expr("r.doc_id <=> m.doc_id AND r.tk = m.tk"), "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: all documents against all benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS win
  FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM (SELECT *, least(10, len(w)) AS l FROM b WHERE len(w) > 0))),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
dw AS (
  SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
o AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw USING (l, win)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM o) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(n.s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {"op3_decontamination": ORACLE}
