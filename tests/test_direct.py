"""Searches over chunks without stored postings, against those over stored ones."""

from glosspan.operators import passages, retrieval
from glosspan.operators.index import Index

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]


def documents(spark):
    rows = [(f"s{i % 3}/{i}.txt", " ".join(WORDS[(i * 7 + j * j) % 8] for j in range(3 + i % 5 * 9)), i) for i in range(60)]
    rows += [(f"s9/{i}.txt", "alpha beta copies", i) for i in range(60, 80)] + [("s9/none.txt", "", 80)]
    return spark.createDataFrame(rows, "source string, text string, seq long")


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"], tuple(map(tuple, r["contributions"]))) for r in frame.collect())


def test_chunks_are_scored_without_postings(spark, tmp_path):
    index = Index.of(documents(spark), size=10, overlap=2)
    index.save(str(tmp_path / "i"))
    stored = Index.load(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([("a", "alpha beta alpha"), ("b", "theta"), ("c", "copies gamma unknown"), ("d", "nothing"), ("e", " ".join(WORDS))], "query_id string, query string")
    index.postings = None  # what a search must not ask for
    wanted = retrieval.ranked(retrieval.bm25_scores(stored, queries), 7)
    assert rows(retrieval.bm25(index, queries, 7)) == rows(wanted)
    assert rows(retrieval.bm25(stored, queries, 7)) == rows(wanted)
    assert rows(retrieval.bm25_bounded(index, queries, 7)) == rows(wanted)
    for exact in (False, True):
        assert rows(retrieval.scoped(index, queries, "s9", 3, exact=exact)) == rows(retrieval.scoped(stored, queries, "s9", 3, exact=exact))
    graded = retrieval.coverage_grades(index, queries, retrieval.bm25(index, queries, 3))
    assert sorted(map(tuple, graded.collect())) == sorted(map(tuple, retrieval.coverage_grades(stored, queries, wanted.where("rank <= 3")).collect()))


def test_stored_postings_are_joined_with_terms_not_with_queries(spark, tmp_path):
    Index.of(documents(spark), size=10, overlap=2).save(str(tmp_path / "i"))
    stored = Index.load(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([(f"q{i}", "alpha beta") for i in range(50)], "query_id string, query string")
    found = retrieval.bm25(stored, queries, 2)
    assert found.count() == 100
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_windows_stand_where_their_words_are_whole(spark):
    docs = spark.createDataFrame([("d", "xone two threex one two three"), ("e", "ab b"), ("f", "a\u00a0b  c d")], "source string, text string")
    asked = spark.createDataFrame([("d", "one two three"), ("e", "b"), ("e", "b b"), ("f", "b c"), ("f", "")], "source string, passage string")
    got = {(r["source"], r["passage"]): (r["start"], r["end"]) for r in passages.located(docs, asked, whole=True).collect()}
    assert got == {("d", "one two three"): (16, 29), ("e", "b"): (3, 4), ("e", "b b"): (None, None), ("f", "b c"): (2, 6), ("f", ""): (None, None)}


def test_offsets_are_running_sums(spark):
    from glosspan.functions.text import page_offsets
    from glosspan.operators.chunking import word_offsets

    rows = spark.createDataFrame([(0, " ab  c\n", ["ab", "c"], ["x", "", "yz"]), (1, "", [], []), (2, "q", ["q"], None)], "i int, text string, found array<string>, pages array<string>")
    got = [tuple(r) for r in rows.select("i", word_offsets("text", "found"), page_offsets("pages")).orderBy("i").collect()]
    assert got[:2] == [(0, [1, 5], [0, 3, 5]), (1, [], [])] and got[2][1] == [0]
    assert "aggregate(" not in rows.select(word_offsets("text", "found"))._jdf.queryExecution().optimizedPlan().toString()


def test_dense_search_holds_a_tile_of_scores_at_once(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, i, [float(1 + i % 7), float(i % 5), 1.0]) for i in range(50)], "id long, seq long, vector array<double>")
    queries = vectors.selectExpr("cast(id AS string) AS query_id", "vector")
    whole = sorted((r["query_id"], r["rank"], r["id"]) for r in retrieval.dense(vectors, queries, 4).collect())
    monkeypatch.setattr(retrieval, "TILE", 7)
    sent = type("Sent", (), {"value": [(r["query_id"], r["vector"]) for r in queries.collect()]})()
    batch = vectors.toArrow().select(["id", "seq", "vector"]).combine_chunks().to_batches()[0]
    parts = list(retrieval._best_of(sent, ["id", "seq"], 4)(iter([batch.slice(0, 30), batch.slice(30)])))
    found = sorted((q, i) for p in parts for q, i in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True))
    assert found == sorted((q, i) for q, _, i in whole)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") not in (None, "-1")


def test_dense_search_computes_few_pairs_twice(spark, monkeypatch):
    """Most pairs get no further than a product in single precision; what is near the k-th best is ranked by double precision."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[300:340] = x[:40] * 3  # equal directions
    x[500] = x[7] + 1e-9  # nearer than single precision tells
    x[5], x[6], x[8, 0], x[9, 1] = 0, 1e-200, np.nan, np.inf
    vectors = spark.createDataFrame([(i, i, v) for i, v in enumerate(x.tolist())] + [(900, 900, [1.0]), (901, 901, None), (902, 902, [None] + [1.0] * 15)], "id long, seq long, vector array<double>").repartition(3)
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
        cos = x @ x.T / length[:, None] / length
    cos[~np.isfinite(cos)] = -1
    expected = {(str(q), rank + 1, int(i)) for q in range(900) for rank, i in enumerate(sorted(np.flatnonzero(cos[q] > 0), key=lambda i: (-round(cos[q, i], 9), i))[:4])}
    monkeypatch.setattr(retrieval, "TILE", 64)
    queries = vectors.selectExpr("cast(id AS string) AS query_id", "vector")
    got = {(r["query_id"], r["rank"], r["id"]) for r in retrieval.dense(vectors, queries, 4).collect()}
    assert {r for r in got if int(r[0]) < 900} == expected and ("900", 1, 900) in got
    held, computed = retrieval._matrices(queries.toArrow()), []
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda path, a, b: computed.append(len(a)) or plain(path, a, b))
    sent = type("Sent", (), {"value": held})()
    batches = vectors.toArrow().select(["id", "seq", "vector"]).combine_chunks().to_batches()
    assert sum(b.num_rows for b in retrieval._best_of(sent, ["id", "seq"], 4)(iter(batches))) > 3500
    assert sum(computed) < 900 * 900 / 3


def test_dense_search_by_many_vectors_is_dealt_to_the_cores(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, i, [float(1 + i % 7), float(i % 5), 1.0]) for i in range(50)], "id long, seq long, vector array<double>").coalesce(1)
    queries = vectors.selectExpr("cast(id AS string) AS query_id", "vector")
    whole = sorted((r["query_id"], r["rank"], r["id"]) for r in retrieval.dense(vectors, queries, 4).collect())
    monkeypatch.setattr(retrieval, "TILE", 7)
    found = retrieval.dense(vectors, queries, 4)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 8  # one partition of vectors: the queries are cut
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect()) == whole
