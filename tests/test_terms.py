"""Terms that tasks cut from batches of bytes, against those of the tokenizer's own expression."""

import random

from glosspan.functions.text import DEFAULT, Tokenizer
from glosspan.operators.terms import END, lists, sent


def cut(frame, tokenizer):
    found = {}
    for batch in frame.select("i", sent(tokenizer).alias("s")).toArrow().combine_chunks().to_batches():
        for part in (batch.slice(0, 3), batch.slice(3)):  # also from the middle of a batch
            made = [terms for run in lists(part.column(1), tokenizer.stopwords) for terms in run.to_pylist()]
            found |= dict(zip(part.column(0).to_pylist(), made, strict=True))
    return found


def test_terms_of_bytes_are_those_of_the_expression(spark):
    pick = random.Random(5)
    texts = ["", "a", "The END_of 3rd", "z", "x", " -- ", "Ünï cödé ÀÉÎ ßtraße µ ª º ²½", "İstanbul ȺȾ", "ΣΟΦΟΣ Привет 日本語 text", "\U0001d400\U0001f600b é", "a\x00b\x7fc\x85d e", "end", "start", None]
    texts += ["".join(chr(c) for c in range(a, min(END + 8, a + 7))) for a in range(0, END, 7)]
    texts += ["".join(pick.choice("aB_9 é É-ÿßΩ,") for _ in range(pick.randrange(60))) for _ in range(1200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for tokenizer in (DEFAULT, Tokenizer(stopwords=()), Tokenizer("[a-z]+")):
        wanted = {r["i"]: r["t"] for r in frame.select("i", tokenizer.terms_of("text").alias("t")).collect()}
        found = cut(frame, tokenizer)
        assert {i: t or [] for i, t in found.items()} == {i: t or [] for i, t in wanted.items()}


def test_a_pass_over_chunks_makes_no_lists_of_plain_texts(spark):
    frame = spark.createDataFrame([(0, "Plain and straße"), (1, "日本語 too")], "i int, text string")
    rows = {r["i"]: r["s"] for r in frame.select("i", sent(DEFAULT).alias("s")).collect()}
    assert rows[0]["text"] == "Plain and straße" and rows[0]["terms"] is None
    assert rows[1]["text"] is None and rows[1]["terms"]


def test_terms_are_counted_without_postings(spark):
    from pyspark.sql import functions as F

    from glosspan.operators import analytics
    from glosspan.operators.index import Index

    docs = spark.createDataFrame([("a", "one Two two", 0), ("b", "two three Ω", 1), ("c", "", 2)], "source string, text string, seq long")
    index = Index.of(docs, size=2, overlap=0)
    wanted = index.postings.groupBy("term").agg(F.sum("tf")).collect()
    index.postings = None  # what counting must not ask for
    assert sorted(map(tuple, analytics.term_counts(index).collect())) == sorted(map(tuple, wanted))
    assert tuple(analytics.stats(index, 2).first()[:4]) == (2, 4, 6, 4)
    empty = Index.of(docs.limit(0))
    assert analytics.top_terms(empty).collect() == [] and tuple(analytics.stats(empty, 2).first()) == (0, 0, 0, 0, [])


def test_document_terms_are_those_of_all_weights(spark, tmp_path, monkeypatch):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from glosspan.functions.text import descriptive
    from glosspan.operators import analytics
    from glosspan.operators.index import Index

    pick = random.Random(3)
    rows = [(f"s{i % 50}", " ".join(f"w{int(pick.paretovariate(0.5)) % 400}" for _ in range(pick.randrange(60))), i) for i in range(70)]
    docs = spark.createDataFrame([*rows, ("x", "the 123 ab", 70), ("y", "", 71)], "source string, text string, seq long").repartition(5)
    index = Index.of(docs, size=10, overlap=3)
    tf = index.postings.where(descriptive("term")).groupBy("source", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("tf") * F.log(F.lit(1.0 + index.chunks.select("source").distinct().count()) / F.col("df"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc(F.round("weight", 9)), "term"))
    wanted = sorted(map(tuple, tf.join(df, "term").withColumn("weight", weight).withColumn("rank", rank).where("rank <= 5").select("source", "rank", "term", "weight").collect()))
    index.save(str(tmp_path / "i"))
    stored = Index.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, analytics.document_terms(stored, 5).collect())) == wanted
    index.postings = None  # what a derived index must not ask for
    for common in (1 << 17, 9):
        monkeypatch.setattr(analytics, "COMMON", common)
        found = analytics.document_terms(index, 5)
        assert sorted(map(tuple, found.collect())) == wanted
    assert analytics.document_terms(Index.of(docs.limit(0))).collect() == []
