"""The segmented index against one built anew, and watched folders that stop in the middle of a batch."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glosspan.engine import Engine
from glosspan.operators import retrieval
from glosspan.operators.index import Index, chunked
from glosspan.operators.segments import Segments
from glosspan.sources.settings import Settings
from glosspan.store import Conflict
from glosspan.streaming.source import Manifests, listing


def documents(spark, texts, first=0):
    return spark.createDataFrame([(s, t, first + i) for i, (s, t) in enumerate(texts.items())], "source string, text string, seq long").coalesce(1)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_segments_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    store, held, seen = Segments(spark, str(tmp_path / "s"), fanout=2), {}, set()
    for _ in range(6):
        changed = {f"d{rng.randint(0, 9)}": " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3)}
        removed = [s for s in held if rng.random() < 0.2 and s not in changed]
        fresh = documents(spark, changed, store.next_seq())
        store.publish(chunked(fresh, size=10, overlap=2), spark.createDataFrame([(s,) for s in [*changed, *removed, "unknown"]], "source string"))
        held = {s: t for s, t in held.items() if s not in changed and s not in removed} | changed
        seen |= {r["level"] for r in store.listed()}
        index = store.index()
        whole = Index.of(documents(spark, held), size=10, overlap=2)
        assert rows(index.chunks, "id", "text") == rows(whole.chunks, "id", "text")
        assert rows(index.postings, "id", "term", "tf", "length") == rows(whole.postings, "id", "term", "tf", "length")
        assert index.totals() == whole.totals()
    assert max(seen) >= 2 and len(store.listed()) < 6
    asked = spark.createDataFrame([("q", "w1 w2 w3 w3")], "query_id string, query string")
    best = lambda i: sorted((r.id, round(r.score, 9)) for r in retrieval.bm25_scores(i, asked).collect())
    assert best(index) == best(whole)
    with pytest.raises(Conflict):
        store.publish(None, spark.createDataFrame([("d1",)], "source string"), after=store.version() - 1)


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    store = Segments(spark, str(tmp_path / "s"))
    store.publish(chunked(documents(spark, {f"d{i}": f"word{i} " * 200 for i in range(200)})), spark.createDataFrame([], "source string"))
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet"))
    before = size()
    store.publish(chunked(documents(spark, {"d3": "other words"}, store.next_seq())), spark.createDataFrame([("d3",)], "source string"))
    assert size() - before < before / 2
    index = store.index()
    assert index.totals()[0] == index.chunks.count() and index.blocks is None
    assert [r.text for r in index.chunks.where("source = 'd3'").collect()] == ["other words"]


def test_bounded_search_reads_less(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"d{i:03}": " ".join(["common"] * rng.randint(1, 3) + [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 30))] + (["rare"] * 3 if i % 40 == 0 else [])) for i in range(400)}
    Index.of(documents(spark, texts)).save(str(tmp_path / "i"))
    index = Index.load(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([("1", "rare common"), ("2", "common"), ("3", "aaa bbb common rare"), ("4", "nothing"), ("5", "")], "query_id string, query string")
    pick = lambda frame: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in frame.collect())
    assert pick(retrieval.bm25_bounded(index, asked, 3)) == pick(retrieval.bm25(index, asked, 3))
    rare = asked.where("query_id = '1'")
    parts = retrieval.bm25_bounded_scores(index, rare, 3)
    assert parts.rows_read() < index.postings.where("term IN ('rare', 'common')").count() / 2


def test_scoped_depth(spark):
    rng = random.Random(5)
    scores = spark.createDataFrame([(q, f"i{i}", i, 0, rng.choice([0.1, 0.5, 0.5000001, rng.random()]), i % 3 == 0) for q in "ab" for i in range(300)], "query_id string, id string, seq long, position int, score double, kept boolean")
    for depth in (0, 1, 7, 150, 300, 900):
        expected = retrieval.ranked(scores, depth).where("kept")
        got = retrieval.within_depth(scores, depth, F.col("kept"))
        assert rows(got, "query_id", "id") == rows(expected, "query_id", "id")


def test_manifests(tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("a")
    (folder / ".b.txt").write_text("hidden")
    (folder / "c.bin").write_text("no loader")
    kept = Manifests(str(tmp_path / "m"))
    take = lambda: kept.take(listing([str(folder)]))
    assert take() == 1 and take() == 1 and kept.name() == kept.name()
    (folder / "sub").mkdir()
    (folder / "sub" / "d.md").write_text("d")
    (folder / "a.txt").unlink()
    assert take() == 2
    found = {(row[0].rsplit("/", 1)[1], row[1]) for k in range(kept.parts) for row in kept.difference(1, 2, k)}
    assert found == {("d.md", "changed"), ("a.txt", "removed")}
    kept.retire(2)
    assert kept.versions() == [2]
    assert [p for p, *_ in listing([str(folder)], ignored=[str(folder / "sub")])] == []


def run_until(query, done, rounds=200):
    for _ in range(rounds):
        if done() or not query.isActive:
            return
        time.sleep(0.3)


def test_a_stopped_stream_applies_each_change_once(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("alpha")
    engine = Engine(spark, Settings(index_path=str(tmp_path / "ix")), clock=lambda: "now")
    told = []

    def fails_once(changes):
        told.append(changes.count())
        if len(told) == 1:
            raise RuntimeError("stopped in the middle of a batch")

    first = engine.watch(str(folder), after=fails_once).start("100 milliseconds")
    run_until(first, lambda: False)
    assert not first.isActive and engine.index().totals()[0] == 1
    published = engine.store.versions()[-1]
    (folder / "b.txt").write_text("beta")
    second = engine.watch(str(folder), after=fails_once).start("100 milliseconds")
    run_until(second, lambda: len(told) == 2)
    second.stop()
    # The first batch came again and changed nothing; the next one has the new file only.
    assert told == [1, 1] and engine.store.versions()[-1] == published + 1
    assert {r.text for r in engine.index().chunks.collect()} == {"alpha", "beta"}


def test_postings_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """A batch's postings stay with the task that made them, in term order within each file."""
    kind, dealt = type(spark.range(1)), []
    kept = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *columns: dealt.append(columns) or kept(self, *columns))
    store = Segments(spark, str(tmp_path / "index"), fanout=2)
    none = spark.createDataFrame([], "source string")
    for n in range(2):  # the second batch is merged with the first
        store.publish(chunked(documents(spark, {f"d{n}{i}": f"word{i} container zebra{i % 3}" for i in range(20)})), none)
    assert not dealt
    rows = store.index().postings.select(F.input_file_name().alias("file"), "term", "id").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file, []).append((r.term, r.id))
    assert len(rows) == 2 * 20 * 3 and all(found == sorted(found) for found in by_file.values())


def test_a_posting_names_its_chunk_once(spark, tmp_path):
    """Stored postings have one column for all that is known of the chunk, and their bounds are not shuffled."""
    docs = spark.createDataFrame([("a b/ü 7.txt", "one two two", 5), ("", "two three", 6), ("none", "", 7)], "source string, text string, seq long")
    whole = Index.of(docs, size=2, overlap=1)
    whole.save(str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).columns == ["term", "chunk", "tf"]
    kept, every = Index.load(spark, str(tmp_path / "i")), ("id", "source", "seq", "position", "term", "tf", "length")
    assert rows(kept.postings, *every) == rows(whole.postings, *every)
    Index(whole.chunks, kept.postings).save(str(tmp_path / "j"))
    again = Index.load(spark, str(tmp_path / "j"))
    assert rows(again.postings, *every) == rows(whole.postings, *every)
    assert rows(again.sources(), "source", "chunks", "terms") == [("", 1, 2), ("a b/ü 7.txt", 2, 4)]
    asked = whole.postings.select("term").distinct()
    for index in (kept, again):
        assert rows(index.bounds_of(asked), "term", "block", "n", "most_tf", "least_length") == rows(whole.bounds_of(asked), "term", "block", "n", "most_tf", "least_length")


def test_postings_are_ordered_run_by_run(spark, tmp_path, monkeypatch):
    from glosspan.operators import index as module

    texts = {f"d{i}": " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(12)) for i in range(50)}
    whole = Index.of(documents(spark, texts), size=5, overlap=1)
    monkeypatch.setattr(module, "RUN", 8)
    stored = module.inverted(whole.chunks)
    assert rows(module.unpacked(stored), "id", "term", "tf", "length") == rows(whole.postings, "id", "term", "tf", "length")
    assert "Sort" not in stored._jdf.queryExecution().optimizedPlan().toString()


def test_many_replaced_sources_and_many_asked_terms_shuffle_no_rows(spark, tmp_path, monkeypatch):
    from glosspan.operators import direct, segments

    store, none = Segments(spark, str(tmp_path / "s")), spark.createDataFrame([], "source string")
    store.publish(chunked(documents(spark, {f"d{i}": f"alpha beta w{i % 5}" for i in range(40)})), none)
    store.publish(chunked(documents(spark, {f"d{i}": f"alpha gamma w{i % 3}" for i in range(0, 40, 2)}, 40)), spark.createDataFrame([(f"d{i}",) for i in range(0, 40, 2)], "source string"))
    queries = spark.createDataFrame([("a", "alpha w1 w2"), ("b", "beta w0")], "query_id string, query string")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    pick = lambda: sorted((r.query_id, r["rank"], r.id, r.score) for r in retrieval.bm25(store.index(), queries, 7).collect())
    wanted = pick()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(segments, "SENT", 3)
        assert all("SortMergeJoin" not in plan(getattr(store.index(), name)) for name in ("chunks", "postings"))
        assert pick() == wanted
        monkeypatch.setattr(Segments, "_told_apart", lambda self, held: False)  # hashes that are not as good as names
        assert "SortMergeJoin" in plan(store.index().chunks) and pick() == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    monkeypatch.setattr(direct, "MANY", 1)
    assert "ollect_list" not in plan(direct.best(store.index(), retrieval.query_terms(queries), 7)) and pick() == wanted
