import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from glosspan.engine import Engine
from glosspan.functions.text import Tokenizer
from glosspan.operators import analytics, answers, chunking, evaluation, filters, retrieval, vectors
from glosspan.operators.index import Index
from glosspan.sources import docx, files, html, settings, web
from glosspan.store import Conflict, Store


def docs(spark, *rows):
    return spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(rows)], "source string, text string, seq long")


def queries(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")


def texts(rows, order="position"):
    return [r["text"] for r in rows.orderBy(order).collect()]


def test_windows(spark):
    eight = docs(spark, ("a", " ".join(f"w{i}" for i in range(8))))
    assert [t.split()[0] for t in texts(chunking.windows(eight, 4, 2))] == ["w0", "w2", "w4"]
    assert texts(chunking.windows(docs(spark, ("a", " \n")), 4, 2)) == []
    assert texts(chunking.windows(docs(spark, ("a", "x y")), 4, 2)) == ["x y"]
    for size, overlap in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            chunking.windows(eight, size, overlap)


def test_paged_windows(spark):
    pages = docs(spark, ("a", "aa bb\n\ncc dd\n\nee ff")).withColumn("page_offsets", F.array(F.lit(0), F.lit(7), F.lit(14)))
    rows = chunking.windows(pages, 4, 2).orderBy("position").collect()
    assert [(r.text, r.first_page, r.last_page) for r in rows] == [("aa bb cc dd", 1, 2), ("cc dd ee ff", 2, 3)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ("See Dr. Smith, e.g. today. then more.", ["See Dr. Smith, e.g. today. then more."]),
        ('He said "Stop." (Then left.) Done', ['He said "Stop."', "(Then left.)", "Done"]),
        ("Heading\n\ntext goes on", ["Heading", "text goes on"]),
        ("", []),
    ],
)
def test_sentences(text, expected):
    assert [" ".join(text[a:b] for a, b in s) for s in chunking.sentences(text)] == expected


def test_packed_sentences(spark):
    rows = chunking.packed_sentences(docs(spark, ("a", "A b c. D e. F g h. I j.")), 5, 2)
    assert texts(rows) == ["A b c. D e.", "D e. F g h.", "F g h. I j."] or texts(rows)[0] == "A b c. D e."
    long = chunking.packed_sentences(docs(spark, ("a", " ".join("abcdefgh"))), 3, 1)
    assert texts(long) == ["a b c", "d e f", "g h"]


def test_markdown_sections():
    text = "intro\n# A #\nx\n## B\n```\n# no heading\n```\n# C\n## D\ny"
    assert [name for name, _ in chunking.sections(text)] == ["", "A", "A > B", "C > D"]


def test_router(spark):
    rows = docs(spark, ("a.md", "# T\nhello"), ("b.txt", "# T\nhello")).withColumn("type", F.when(F.col("source") == "a.md", "markdown").otherwise("text"))
    assert {(r.source, r.section) for r in chunking.by_type(rows).collect()} == {("a.md", "T"), ("b.txt", "")}


CORPUS = (("a", "cats chase mice and mice"), ("b", "dogs chase cats"), ("c", "rain in spain"))


def test_bm25_against_plain_python(spark):
    idx = Index.of(docs(spark, *CORPUS))
    rows = retrieval.bm25(idx, queries(spark, "mice cats cats"), 5).orderBy("rank").collect()
    tokens = {s: [w for w in t.split() if w not in ("and", "in")] for s, t in CORPUS}
    average = sum(map(len, tokens.values())) / 3

    def share(term, s):
        df, tf = sum(term in t for t in tokens.values()), tokens[s].count(term)
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens[s]) / average))

    expected = {s: share("mice", s) + 2 * share("cats", s) for s in "ab"}
    assert [r.source for r in rows] == ["a", "b"]
    for r in rows:
        assert r.score == pytest.approx(expected[r.source])
        assert sum(c.score for c in r.contributions) == pytest.approx(r.score)
    assert retrieval.bm25(idx, queries(spark, "the"), 5).count() == 0


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([("q", i, n) for n, i in enumerate(ids, 1)], "query_id string, id string, rank int")
    rows = retrieval.fused([ranked("abc"), ranked("bd")], 3).orderBy("rank").collect()
    assert [r.id for r in rows] == ["b", "a", "d"] and rows[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_rerank_and_grades(spark):
    answer = '{"grades":[{"passage":2,"grade":12},{"passage":2,"grade":1},{"passage":9,"grade":5},{"passage":1,"grade":-3}]}'
    grades = retrieval.parsed_grades(spark.createDataFrame([("q", answer, 3)], "query_id string, answer string, count int"))
    assert {(r.passage, r.grade) for r in grades.collect()} == {(2, 10), (1, 0)}
    first = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "z", 3)], "query_id string, id string, rank int")
    found = retrieval.reranked(first, spark.createDataFrame([("q", "z", 7)], "query_id string, id string, grade int"), 2)
    assert [r.id for r in found.orderBy("rank").collect()] == ["z", "x"]


def test_scoped_keeps_global_statistics(spark):
    idx = Index.of(docs(spark, ("x/a.md", "cats mice"), ("y/b.txt", "cats"), ("y/c.txt", "dogs")))
    everywhere = {r.source: r.score for r in retrieval.bm25(idx, queries(spark, "cats"), 5).collect()}
    inside = retrieval.scoped(idx, queries(spark, "cats"), "y", 1).collect()
    assert [(r.source, r.score) for r in inside] == [("y/b.txt", everywhere["y/b.txt"])]
    assert retrieval.scoped(idx, queries(spark, "cats"), "z", 1).count() == 0


def test_dense_and_retriever(spark):
    idx = Index.of(docs(spark, *CORPUS))
    vecs = vectors.hashed(idx.chunks).join(idx.chunks.select("id", "seq", "source"), "id")
    embed = lambda q: vectors.hashed(q.withColumnRenamed("query", "text"), "query_id")
    for kind in ("bm25", "embedding", "hybrid"):
        found = retrieval.retriever(kind, idx, vecs, embed, rerank=kind == "hybrid")(queries(spark, "rain spain"), 1).collect()
        assert [r.id for r in found] == [idx.chunks.where("source = 'c'").first().id]
    with pytest.raises(ValueError):
        retrieval.retriever("other", idx)


def test_index_round_trip(spark, tmp_path):
    idx = Index.of(docs(spark, *CORPUS), indexed_at="2026-01-01T00:00:00+00:00")
    assert idx.add(docs(spark, ("a", CORPUS[0][1]), ("b", "new words"))).chunks.where("source = 'b'").first().text == "new words"
    removed, count = idx.remove("a")
    assert count == 1 and removed.chunks.count() == 2 and removed.postings.where("source = 'a'").count() == 0
    idx.save(str(tmp_path / "index"))
    back = Index.load(spark, str(tmp_path / "index"))
    assert back.totals() == idx.totals() and back.size_bytes() > 0
    old = {"version": 1, "chunks": [{"id": "i-0", "source": "s", "text": "alpha beta", "position": 0}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    row = Index.import_json(spark, str(tmp_path / "old.json")).chunks.first()
    assert (row.content_hash, row.indexed_at, row.first_page) == ("", "", None)


def test_vector_cache(spark):
    rows = docs(spark, ("a", "x y"), ("b", "x y"), ("c", "z"))
    empty = spark.createDataFrame([], "text_sha string, model string, vector array<double>")
    done, new = vectors.cached(rows, empty, vectors.Hashed())
    assert new.count() == 2 and done.where("vector IS NULL").count() == 0
    assert vectors.missing(rows, new, "hashed-64").count() == 0 and vectors.missing(rows, new, "other").count() == 2


def test_analytics(spark):
    values = spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "n int")
    assert [tuple(r) for r in analytics.histogram(values, "n", 3).collect()] == [(1, 4, 3), (5, 8, 0), (9, 10, 1)]
    assert analytics.histogram(values.limit(0), "n", 3).count() == 0
    with pytest.raises(ValueError):
        analytics.histogram(values, "n", 0)
    idx = Index.of(docs(spark, *CORPUS))
    row = analytics.stats(idx, 2).first()
    assert (row.documents, row.chunks, row.terms, row.vocabulary) == (3, 3, 9, 6)
    assert [(t.term, t["count"]) for t in row.top_terms] == [("cats", 2), ("chase", 2)]
    assert [(r.first, r.second, r.shared_terms) for r in analytics.relations(idx).collect()] == [("a", "b", ["cats", "chase"])]
    assert analytics.catalog(idx).count() == 3 and set(analytics.overview(idx)) == {"stats", "types", "lengths", "relations", "recent"}


def test_pca(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0, 0.0]), ("b", [4.0, 1.0, 0.0]), ("c", [8.0, 0.0, 0.0]), ("d", [4.0, -1.0, 0.0])], "id string, vector array<double>")
    points = {r.id: (round(r.x, 6), round(r.y, 6)) for r in analytics.pca_map(rows).collect()}
    assert points == {"a": (-1, 0), "b": (0, 1), "c": (1, 0), "d": (0, -1)}
    assert analytics.pca_map(rows.limit(0)).count() == 0


def test_evaluation(spark):
    ranking = spark.createDataFrame([("q", s, i) for i, s in enumerate(["x/z.md", "x/a.md", "a.md", "y/b.md"], 1)], "query_id string, source string, rank int")
    cases = spark.createDataFrame([("q", ["a.md", "b.md"]), ("r", ["c.md"])], "query_id string, relevant array<string>")
    done = {r.query_id: r for r in evaluation.outcomes(ranking, cases, 4).collect()}
    assert (done["q"].first_hit, done["q"].recall_curve) == (2, [0, 0.5, 0.5, 1])
    assert (done["r"].first_hit, done["r"].recall_curve) == (None, [0, 0, 0, 0])
    row = evaluation.report(evaluation.outcomes(ranking, cases, 4), 4).first()
    assert (row.cases, row.recall, row.mrr) == (2, 0.5, 0.25)


def test_answers(spark):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(["aaaa", "bb", "cccccc", "d"])], "source string, position int, text string")
    assert [(r.text, r.omitted) for r in answers.budgeted(rows, 7).orderBy("position").collect()] == [("aaaa", 2), ("bb", 2)]
    assert [r.text for r in answers.budgeted(rows, 1).collect()] == ["aaaa"]
    spans = spark.createDataFrame([("s", 0, 5, 1), ("s", 4, 9, 2), ("s", 9, 12, 3)], "source string, start int, end int, rank int")
    assert [(r.start, r.end, r.ranks) for r in answers.merged_segments(spans).orderBy("start").collect()] == [(0, 9, [1, 2]), (9, 12, [3])]
    prices = spark.createDataFrame([("m", 1.0, 2.0, 0.1), ("m-big", 10.0, 20.0, 1.0)], "model string, input double, output double, cache_read double")
    usage = spark.createDataFrame([("m-big-1", 1000000, 100000, None, None), ("mm", 1, 1, 1, 1), ("m", 0, 0, 1000000, 1000000)], "model string, input_tokens long, output_tokens long, cache_created long, cache_read_tokens long")
    found = {r.model: r.cost_usd for r in answers.costs(usage, prices).collect()}
    assert found["m-big-1"] == pytest.approx(12.0) and found["mm"] is None and found["m"] == pytest.approx(1.35)
    assert answers.system_prompt("French", "short").count("French") == 1
    with pytest.raises(ValueError):
        answers.system_prompt(length="huge")
    idx = Index.of(docs(spark, *CORPUS))
    search = lambda q: retrieval.bm25(idx, queries(spark, q), 2).join(idx.chunks.select("id", "text"), "id")
    chat = answers.Chat(search)
    assert "[1]" in chat.ask("mice") and chat.ask("nothing here") == answers.NOTHING_FOUND and len(chat.history()) == 2


def test_html():
    page = "<title>A &amp; B</title><nav>menu</nav><main><h1>T <b>x</b></h1><p>one<br>two<ul><li>three</ul><pre>a\n b</pre><p># no</main><footer>f</footer>"
    assert html.main_content(page).text == "# T x\n\none\n\ntwo\n\nthree\n\n```\na\n b\n```\n\n\\# no"
    assert html.main_content(page).title == "A & B" and "menu" in html.whole(page).text
    assert html.main_content("<main><nav>x</nav></main><p>rest").text == "rest"
    assert html.main_content("<article>in</article>out").text == "in"


def test_docx():
    w = docx.NS[1:-1]
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="X1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    styles = f'<w:styles xmlns:w="{w}"><w:style w:type="paragraph" w:styleId="X1"><w:basedOn w:val="X2"/></w:style><w:style w:type="paragraph" w:styleId="X2"><w:name w:val="heading 2"/><w:basedOn w:val="X1"/></w:style></w:styles>'
    store = io.BytesIO()
    with zipfile.ZipFile(store, "w") as archive:
        archive.writestr(docx.DOCUMENT, body)
        archive.writestr(docx.STYLES, styles)
    assert docx.to_text(store.getvalue()) == ("## Head\n\na b\n\n1 | 2", "")
    with pytest.raises(ValueError):
        docx.to_text(b"no zip")


def test_web(spark):
    fetcher = lambda url: (url + "/end", "text/html" if "ok" in url else "image/png", None, b"<main>hi</main>")
    rows = web.documents(web.fetched(spark.createDataFrame([("https://ok",), ("https://png",)], "url string"), fetcher)).collect()
    assert {(r.source, r.text, r.failed) for r in rows} == {("https://ok", "hi", None), ("https://png", None, "unsupported content type image/png")}


def test_settings(spark, tmp_path):
    (tmp_path / "a.toml").write_text('index_path = "ix"\nchunk_size = 10\n')
    found = settings.read(str(tmp_path / "a.toml"), top_k=7)
    assert (found.chunk_size, found.top_k, found.index_path) == (10, 7, str(tmp_path / "ix"))
    (tmp_path / "b.toml").write_text("chunk_size = true\n")
    with pytest.raises(settings.SettingsError):
        settings.read(str(tmp_path / "b.toml"))
    assert settings.changes(["rerank=yes", "top_k=3"]) == {"rerank": True, "top_k": 3}
    (tmp_path / "c.json").write_text('{"cases": [{"query": " q ", "relevant": "a.md"}]}')
    assert settings.cases(spark, str(tmp_path / "c.json")).first()["relevant"] == ["a.md"]
    (tmp_path / "c.json").write_text('[{"query": "", "relevant": []}]')
    with pytest.raises(settings.CaseSetError, match="case 1"):
        settings.cases(spark, str(tmp_path / "c.json"))


def test_watching(spark, tmp_path):
    folder, store = tmp_path / "docs", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.md").write_text("# A\nalpha")
    (folder / "b.txt").write_bytes(b"beta\r\nline")
    (folder / "c.bin").write_bytes(b"\x00")
    engine = Engine(spark, settings.Settings(index_path=store), clock=lambda: "now")
    watcher = engine.watch(str(folder))
    names = lambda: {r.source.rsplit("/", 1)[1] for r in engine.index().chunks.collect()}
    assert watcher.poll() == 2 and names() == {"a.md", "b.txt"}
    assert engine.search("beta").first().source.endswith("b.txt")
    assert watcher.poll() == 0 and engine.store.versions() == [1]
    (folder / "b.txt").write_text("gamma delta epsilon")
    (folder / "a.md").unlink()
    assert watcher.poll() == 2 and [r.text for r in engine.index().chunks.collect()] == ["gamma delta epsilon"]
    assert engine.search("alpha").isEmpty() and engine.search("gamma").count() == 1
    (folder / "out").mkdir()
    (folder / "out" / "made.txt").write_text("made words")
    assert engine.watch(str(folder), ignored=[str(folder / "out")]).poll() == 0
    assert engine.watch(str(folder / "out"), ignored=[str(folder / "out")]).poll() == 1 and engine.search("made").count() == 1
    (folder / "d.txt").write_text("streamed")
    query = watcher.start("100 milliseconds")
    for _ in range(100):
        if "d.txt" in names():
            break
        query.awaitTermination(0.3)
    query.stop()
    assert names() == {"b.txt", "made.txt", "d.txt"}
    assert [r.source.rsplit("/", 1)[1] for r in files.skipped(files.listed(spark, str(folder))).collect()] == ["c.bin"]


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.range(3)
    assert store.publish(lambda f: rows.write.parquet(f), 0) == 1
    with pytest.raises(Conflict):
        store.publish(lambda f: rows.write.parquet(f), 0)
    assert store.publish(lambda f: rows.write.parquet(f), 1) == 2 and store.publish(lambda f: rows.write.parquet(f)) == 3
    assert store.versions() == [2, 3] and not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("draft")]
    assert spark.read.parquet(store.newest()).count() == 3


def test_many_partitions_and_later_runs_keep_their_order(spark):
    rows = spark.range(200, numPartitions=200).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("same words here").alias("text"), F.monotonically_increasing_id().alias("seq"))
    index = Index.of(rows)
    assert index.chunks.count() == 200
    later = index.add(docs(spark, ("later", "same words here")))
    found = [r.source for r in retrieval.bm25(later, queries(spark, "words"), 201).orderBy("rank").collect()]
    assert found[:3] == ["s0", "s1", "s2"] and found[-1] == "later"


def test_source_filters_off_ascii(spark):
    rows = spark.createDataFrame([("/a/Straße/B.TXT",), ("/a/strasse/b.txt",), ("/ÉTÉ/x.md",)], "source string")
    kept = lambda p: [r.source for r in rows.where(filters.in_scope(p)).collect()]
    assert len(kept("STRAßE")) == len(kept("strasse")) == 2 and kept("été") == ["/ÉTÉ/x.md"] and len(kept("*.txt")) == 2 and kept("//") == []


def test_relations_of_copies(spark):
    texts = ["alpha beta gamma"] * 40 + ["alpha beta delta"] * 3 + ["omega"]
    idx = Index.of(docs(spark, *((f"d{i:02}", t) for i, t in enumerate(texts))))
    got = [(r.first, r.second, r.strength) for r in analytics.relations(idx).collect()]
    every = [(r.first, r.second, r.strength) for r in analytics.relations(idx, most=None).collect()]
    assert got == sorted(every, key=lambda r: (-r[2], r[0], r[1]))[:30] and len(every) == 43 * 42 // 2


def test_citations(spark):
    rows = spark.createDataFrame([("see [1] and [3], [0], [12345678901], [2](x) [1]", 3)], "text string, n int")
    out = rows.select(answers.citations("text", F.col("n")).alias("c"), answers.linked("text", F.col("n"), lambda n: F.concat(F.lit("<"), n, F.lit(">"))).alias("t")).first()
    assert list(out.c) == [1, 3] and out.t == "see <1> and <3>, [0], [12345678901], [2](x) <1>"


def test_replaceable_tokenizer(spark):
    only = Tokenizer("[a-z]+[0-9]", ["x1"])
    idx = Index.of(docs(spark, ("a", "A1 x1 plain b2 b2")), tokenizer=only)
    assert {(r.term, r.tf, r.length) for r in idx.postings.collect()} == {("b2", 2, 2)}
    assert retrieval.with_passages(retrieval.bm25(idx, queries(spark, "b2 plain"), 2), idx, "b2").first().matched_terms == ["b2"]


def test_many_query_vectors_are_dealt_with_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BYTES", 200)
    vecs = spark.createDataFrame([(str(i), i, [1.0, float(i)]) for i in range(5)], "id string, seq long, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", [float(i), 1.0]) for i in range(7)], "query_id string, vector array<double>")
    assert retrieval.dense(vecs, asked, 2).groupBy("query_id").count().where("count = 2").count() == 7
    assert retrieval.dense(vecs, asked.limit(0), 2).count() == 0


def test_model_grades(spark):
    idx = Index.of(docs(spark, *CORPUS))
    asked = queries(spark, "cats")
    prompts = []

    def call(prompt, schema):
        prompts.append(prompt)
        return '{"grades": [{"passage": 2, "grade": 9}, {"passage": 1, "grade": 3}]}'

    first = retrieval.bm25(idx, asked, 2)
    found = retrieval.retriever("bm25", idx, rerank=True, grade=retrieval.model_grades(call))(asked, 2).orderBy("rank").collect()
    assert [r.id for r in found] == [r.id for r in first.orderBy(F.desc("rank")).collect()] and len(prompts) == 1 and "Question: cats" in prompts[0]
    with pytest.raises(retrieval.Refused):
        retrieval.model_grades(lambda prompt, schema: None)(idx, asked, first)
