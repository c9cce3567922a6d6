"""Conversations as a stream, events of queries, SQL table functions, passages, dense blocks, folding."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosspan import sql
from glosspan.functions import text as T
from glosspan.operators import chunking, passages, retrieval
from glosspan.operators.answers import NOTHING_FOUND
from glosspan.operators.filters import in_scope
from glosspan.operators.index import Index
from glosspan.streaming import conversations, events


def counted(question, found, history=()):
    return f"{question}: {len(found)} found, {len(history) // 2} before"


def test_conversations_restart_where_they_stopped(spark, tmp_path):
    home, events_in = str(tmp_path), tmp_path / "events"

    def run(*rows):
        spark.createDataFrame(list(rows), conversations.EVENTS).coalesce(1).write.mode("append").parquet(str(events_in))
        told = spark.readStream.schema(conversations.EVENTS).parquet(str(events_in))
        query = conversations.kept(conversations.followed(told, 2, generate=counted), f"{home}/turns", f"{home}/checkpoint", availableNow=True)
        query.awaitTermination()
        return {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{home}/turns").collect()}

    first = run(("a", 0, "asked", "q0", ["p"]), ("a", 1, "asked", "q1", []), ("b", 0, "said", "hello", None))
    assert first["a", 0].answer == "q0: 1 found, 0 before" and first["a", 1].answer == NOTHING_FOUND
    # A question without passages leaves no state.
    assert first["a", 1].remembered == [0] and first["b", 0].remembered == [0]
    later = run(("a", 2, "asked", "q2", ["p", "p"]), ("a", 3, "asked", "q3", ["p"]), ("b", 1, "reset", None, None), ("b", 2, "said", "again", None))
    assert later["a", 2].answer == "q2: 2 found, 1 before" and later["a", 3].remembered == [2, 3]
    assert later["b", 1].remembered == [] and later["b", 2].remembered == [2] and len(later) == 7
    assert {(r.conv_id, r.turn) for r in conversations.windows(spark.read.parquet(f"{home}/turns")).collect()} == {("a", 2), ("a", 3), ("b", 2)}


def test_silent_conversations_are_forgotten(spark, tmp_path):
    told = tmp_path / "events"
    row = lambda turn: spark.createDataFrame([("a", turn, "said", "x", None)], conversations.EVENTS).coalesce(1).write.mode("append").parquet(str(told))
    row(0)
    query = conversations.kept(conversations.followed(spark.readStream.schema(conversations.EVENTS).parquet(str(told)), 5, quiet=0.5), str(tmp_path / "turns"), str(tmp_path / "check"), processingTime="200 milliseconds")
    try:
        read = lambda: {r.turn: r.remembered for r in spark.read.schema(conversations.TURNS).parquet(str(tmp_path / "turns")).collect()} if (tmp_path / "turns").exists() else {}
        for turn in (0, 1):
            for _ in range(200):
                if turn in read():
                    break
                time.sleep(0.3)
            if not turn:
                time.sleep(6)
                row(1)
        assert read() == {0: [0], 1: [1]}
    finally:
        query.stop()


def test_events_of_a_query_that_dies(spark, tmp_path):
    told = []
    announcer = events.Announcer(lambda event, details: told.append((event, details.get("error"))), "dies")
    spark.streams.addListener(announcer)
    try:

        def batch(rows, number):
            if rows.count() and number == 1:
                raise RuntimeError("no more")

        spark.range(3).repartition(2).write.parquet(str(tmp_path / "in"))
        query = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.queryName("dies").foreachBatch(batch).trigger(processingTime="100 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
        for _ in range(200):
            if told and told[-1][0] == events.STOPPED:
                break
            time.sleep(0.2)
        assert not query.isActive
    finally:
        spark.streams.removeListener(announcer)
    names = [name for name, _ in told]
    assert names == [events.LISTED, events.UPDATED, events.STOPPED] and "no more" in told[-1][1]


def test_table_functions(spark):
    docs = spark.createDataFrame([("a.md", "# A\none two. Three four five.\n## B\nsix", 7), ("b", "x y z w v u", 8), ("c", None, 9)], "source string, text string, tag int")
    docs.createOrReplaceTempView("some_docs")
    sql.register(spark, Index.of(docs.withColumnRenamed("tag", "seq")))
    pick = lambda frame: sorted(map(tuple, frame.select("id", "source", "text", "position", "section", "tag").collect()))
    ours = {"window_chunks": chunking.windows, "sentence_chunks": chunking.packed_sentences, "section_chunks": chunking.markdown}
    for name, made in ours.items():
        assert pick(spark.sql(f"SELECT * FROM {name}(TABLE(some_docs), 3, 1)")) == pick(made(docs, 3, 1)), name
    assert spark.sql("SELECT * FROM window_chunks(TABLE(some_docs))").count() == 2
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM window_chunks(TABLE(some_docs), 3, 3)").collect()
    assert [r.source for r in spark.sql("SELECT * FROM search('three six', 1)").collect()] == ["a.md"]
    assert spark.sql("SELECT * FROM explain_search('three six')").count() == 2


def test_passages(spark):
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice("abc  \n") for _ in range(rng.randint(0, 60)))
        words = text.split()
        at = rng.randint(0, max(0, len(words) - 1))
        passage = " ".join(words[at : at + rng.randint(1, 6)])[rng.randint(0, 1) :]
        found = re.search(r"\s+".join(map(re.escape, passage.split())), text) if passage.split() else None
        assert passages.Words(text).first(passage) == (found.span() if found else None), (text, passage)
    docs = spark.createDataFrame([("a", "😀 one  two\nthree four one two x"), ("b", None)], "source string, text string")
    asked = spark.createDataFrame([("a", "two three four", 1), ("a", "one two", 2), ("a", "no such", 3), ("a", "one two", 4), ("b", "x", 5), ("z", "x", 6), ("a", None, 7)], "source string, passage string, n int")
    got = {r.n: (r.start, r.end) for r in passages.located(docs, asked).collect()}
    assert got == {1: (7, 21), 2: (2, 10), 3: (None, None), 4: (2, 10), 5: (None, None), 7: (None, None)}


def test_many_passages_of_one_document_go_in_groups(spark, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", 10)
    docs = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(300)))], "source string, text string")
    found = passages.located(docs, chunking.windows(docs, 4, 2).select("source", "position", F.col("text").alias("passage")))
    assert found.where("start IS NULL").count() == 0 and found.count() == found.select("start").distinct().count() == 149


def test_dense_against_plain_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5))
    x[100:200] = x[7]
    x[5] = 0
    rows = spark.createDataFrame([(f"v{i}", i, v.tolist()) for i, v in enumerate(x)] + [("short", 900, [1.0]), ("none", 901, None)], "id string, seq long, vector array<double>").repartition(4)
    q = rng.normal(size=(40, 5))
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)] + [("empty", []), ("null", None)], "query_id string, vector array<double>")
    with np.errstate(all="ignore"):
        score = np.nan_to_num(x @ q.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(q, axis=1))
    expected = {(f"q{j}", rank + 1, f"v{i}") for j in range(40) for rank, i in enumerate(sorted((i for i in range(300) if score[i, j] > 0), key=lambda i: (-round(score[i, j], 9), i))[:7])}
    assert {(r.query_id, r["rank"], r.id) for r in retrieval.dense(rows, asked, 7).collect()} == expected


def test_folding(spark):
    signs = [chr(c) for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(s, f"x{s}Y") for s in signs], "sign string, text string")
    assert [(r.sign, r.t) for r in rows.select("sign", "text", T.casefolded("text").alias("t")).collect() if r.t != f"x{r.sign}Y".casefold()] == []
    kept = lambda source, pattern: spark.createDataFrame([(source,)], "source string").where(in_scope(pattern)).count() == 1
    assert kept("/a/Straße/x.txt", "STRASSE") and kept("/ΣΟΦΟΣ/x", "σοφος") and kept("/İx/y", "i̇X") and not kept("/a/b", "ß")
