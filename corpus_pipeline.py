"""The corpus pipeline: language ID, exact and near deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage
works on all rows that it kept, written as Parquet and read again.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm import decontamination, exact_dedup, jaccard, language, mixing
from glosspan.llm.common import crc_mod, staged, table

#: A text of whose n-grams its language knows less than this part of what that
#: language's training texts usually reach is in no learned language.  The share
#: of a text of n code points is uncertain by about 1 / sqrt(n), which counts in
#: its favour, at every length.
LEAST_PART = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters or without a decision go."""
    filters = language.fit(docs.where(crc_mod("doc_id", 4) != 2))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    found = staged(language.identify(rows, filters, ["row", "text"]), "identified")
    trained = found.where(crc_mod("row.doc_id", 4) != 2).select(F.col("row.lang").alias("lang"), "lang_pred", "known")
    usual = language.usual_share(trained)
    least = spark.createDataFrame([(name, LEAST_PART * share) for name, share in usual.items()], "_lang string, _least double")
    found = found.join(F.broadcast(least), F.col("lang_pred") == F.col("_lang"), "left")
    doubt = 1 / F.sqrt(F.char_length("text"))
    enough = F.col("known") + doubt >= F.coalesce("_least", F.lit(0.0))
    columns = ["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.where((F.col("lang_pred") != "und") & enough).select(*columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest, then the one with the least doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return jaccard.keep_one(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target, taken, first_slot and n_slots.

    Ordered by ``first_slot``, they are the mix; ``taken`` says how many words
    it takes of each, repeats counted.  Columns of these names that the
    documents had before are replaced; of rows that repeat one document each
    gets the larger ``taken`` and the earliest slot.
    """
    keys = ["doc_id", "source", "size", "source_size", "target"]
    made = ["taken", "first_slot", "n_slots"]
    counts = mixing.mix(docs).groupBy(*keys).agg(F.max("taken").alias("taken"), F.min("first_slot").alias("first_slot"), F.max("n_slots").alias("n_slots")).where("taken > 0")
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in (*keys[2:], *made)]).alias("row"), mixing.size_of(F.col("text")).alias("n"))
    joined = rows.alias("r").join(counts.alias("m"), F.expr("r.row.doc_id <=> m.doc_id AND r.row.source <=> m.source AND r.n = m.size"))
    return joined.select("row.*", "m.size", "m.source_size", "m.target", *(f"m.{c}" for c in made))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and the component search cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
