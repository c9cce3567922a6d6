"""Reports, their pages, and the servers in front of an engine."""

import io
import json
import threading
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import functions as F

from glosspan import arguments, cli, reports
from glosspan.engine import Engine, Ports
from glosspan.functions import text as T
from glosspan.operators import answers, chunking
from glosspan.render import html, svg
from glosspan.serve import http, mcp
from glosspan.sources import files, settings

from .test_service import corpus


def generate(question, passages, on_text=None):
    text = "Pull the image [1], not [9]. <b>"
    if on_text:
        for piece in text.split(" "):
            on_text(piece)
    return answers.Generated(text, answers.Usage("m-1", 1000, 500, None, 2000))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("reports")
    made = Engine(spark, settings.Settings(index_path=str(home / "index"), top_k=2), clock=lambda: "2026-01-01T00:00:00+00:00", ports=Ports(generate=generate, prices=[("m", 1.0, 2.0, 0.5)]))
    made.index_paths(corpus(home / "docs"))
    return made


def test_answers_have_usage_and_cost(engine):
    told = []
    made = engine.answer("container image", on_text=told.append)
    assert made.cost_usd == pytest.approx((1000 * 1 + 500 * 2 + 2000 * 0.5) / 1e6) and "".join(told) == made.text.replace(" ", "")
    none = engine.answer("zebra")
    assert (none.text, none.usage, none.cost_usd) == (answers.NOTHING_FOUND, None, None)
    assert made.documents().first().source.endswith("install.md")


def test_conversations(spark, engine):
    seen = []

    def talk(question, passages, history=None):
        seen.append(history)
        return answers.Generated("said [1]", answers.Usage("m", 1, 2))

    chat = answers.Chat(engine.search, talk, 1)
    assert [chat.ask(q) for q in ("container", "image", "zebra", "folder")] == ["said [1]", "said [1]", answers.NOTHING_FOUND, "said [1]"]
    assert seen == [None, *([{"role": "user", "content": f"Question: {q}"}, {"role": "assistant", "content": "said [1]"}] for q in ("container", "image"))] and chat.usage.output_tokens == 2


def test_answer_reports(engine):
    page = reports.answer(engine, "container image").content
    assert '<a href="#passage-1">[1]</a>' in page and "[9]" in page and "&lt;b&gt;" in page and "~$0.0030" in page and "<mark>image</mark>" in page
    plain = reports.answer(engine, "container image", form="markdown").content
    assert "[[1]](#passage-1)" in plain and "**image**" in plain and "~$0.0030" in plain
    with pytest.raises(ValueError):
        reports.answer(engine, "container image", form="pdf")


def test_comparison(engine):
    made = engine.comparison("container image", "top_k=1")
    assert len(made.shared) == 1 and 0 < made.overlap <= 1 and (made.left.label, made.right.label) == ("top_k=2", "top_k=1")
    assert "overlap" in reports.comparison(engine, "container image", "top_k=1").content
    assert "== top_k=1 ==" in reports.comparison(engine, "container image", "top_k=1", form="text").content


def test_other_pages(spark, engine):
    assert "<ol>" not in reports.search(engine, "  ").content
    found = reports.search(engine, "installer", source="*.md", endpoint="/ui/source").content
    assert "/ui/source?path=" in found and "&amp;chunk=" in found and "1 passage in *.md" in found
    page = reports.dashboard(engine).content
    assert page.count("<svg") == 5 and "install.md" in page
    assert "graph LR" in reports.dashboard(engine, "text").content and "<svg" in reports.stats(engine).content
    cases = spark.createDataFrame([("1", "docker container", ["docs/install.md"])], "query_id string, query string, relevant array<string>")
    assert "MRR 1.00" in reports.evaluation(engine, cases).content and "MRR 1.00" in reports.evaluation(engine, cases, form="text").content
    chunk = engine.search("container").first().id
    assert '<section id="passage">' in reports.source(engine, chunk, "container").content and reports.source(engine, "none") is None
    assert html.marked("a<b>", [{"start": 1, "end": 2}, {"start": 1, "end": 3}, {"start": 9, "end": 12}]) == "a<mark>&lt;</mark>b&gt;"
    assert svg.clipped("x" * 30).endswith("…") and "<svg" in svg.network([], "none") and "<svg" in svg.columns([], "none")


def test_arguments():
    assert arguments.query(" a ") == "a" and arguments.number("3", 5, 1, 50, "k") == 3 and arguments.number(None, 5, 1, 50, "k") == 5 and arguments.clamped(99, 5, 1, 50, "k") == 50
    for call in (lambda: arguments.query("  "), lambda: arguments.number("x", 5, 1, 50, "k"), lambda: arguments.number(0, 5, 1, 50, "k"), lambda: arguments.number(51, 5, 1, 50, "k"), lambda: arguments.clamped(True, 5, 1, 50, "k"), lambda: arguments.clamped(0, 5, 1, 50, "k"), lambda: arguments.address("ftp://x"), lambda: arguments.path("http://x")):
        with pytest.raises(arguments.ArgumentError):
            call()


def test_http(engine, tmp_path):
    api = http.Api(engine)
    get = lambda target: api.handle("GET", target)
    post = lambda target, body: api.handle("POST", target, json.dumps(body).encode())
    assert json.loads(get("/health")[2]) == {"status": "ok"}
    found = json.loads(get("/search?q=container+image&top_k=1")[2])["results"]
    assert len(found) == 1 and set(found[0]["matched_terms"]) == {"container", "image"}
    assert [get(t)[0] for t in ("/search?q=%20", "/search?q=a&top_k=51", "/search?q=a&top_k=0", "/stats?top_terms=101", "/nowhere", "/ui/source?chunk=none")] == [422, 422, 422, 422, 404, 404]
    assert api.handle("POST", "/search")[0] == 405 and api.handle("POST", "/ask", b"[")[0] == 422
    assert json.loads(get("/stats")[2])["documents"] == 3
    answer = json.loads(post("/ask", {"question": "container image"})[2])
    assert answer["usage"]["model"] == "m-1" and answer["sources"][0]["rank"] == 1
    (tmp_path / "new.txt").write_text("fresh words")
    assert json.loads(post("/index", {"path": str(tmp_path / "new.txt")})[2])["documents"] == 1 and post("/index", {"path": str(tmp_path / "no")})[0] == 404
    assert engine.remove(str(tmp_path / "new.txt")) == 1
    for target in ("/", "/ui?q=installer", "/ui/ask?q=installer", "/ui/dashboard"):
        assert get(target)[0] == 200 and get(target)[2].startswith(b"<!doctype html>")
    with http.serve(engine, port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/health") as reply:
            assert json.load(reply)["status"] == "ok"
        server.shutdown()


def test_tools(engine, tmp_path):
    told = []
    server = mcp.Server(engine, told.append)
    ask = lambda method, **params: server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    call = lambda name, **given: ask("tools/call", name=name, arguments=given)["result"]
    assert ask("initialize")["result"]["serverInfo"]["name"] == "glosspan" and len(ask("tools/list")["result"]["tools"]) == 8
    assert call("search_documents", query="container image", top_k=99)["structuredContent"]["results"][0]["rank"] == 1
    assert call("search_documents", query=" ")["isError"] and call("index_url", url="x")["isError"] and ask("tools/call", name="other")["error"]["code"] == -32602
    assert "[1]" in call("ask_documents", question="container image")["content"][0]["text"]
    (tmp_path / "new.txt").write_text("fresh words")
    assert call("index_path", path=str(tmp_path))["structuredContent"]["documents"] == 1 and call("remove_path", path=str(tmp_path))["structuredContent"] == {"removed": 1}
    assert [m["method"].rsplit("/", 1)[1] for m in told] == ["list_changed", "updated"] * 2
    assert call("index_stats")["structuredContent"]["documents"] == 3 and "graph LR" in call("index_dashboard")["content"][0]["text"]
    documents = json.loads(ask("resources/read", uri="glosspan://documents")["result"]["contents"][0]["text"])
    assert len(documents) == 3
    chunk = json.loads(ask("resources/read", uri=f"glosspan://chunks/{documents[0]['chunk_ids'][0]}")["result"]["contents"][0]["text"])
    assert chunk["source"] == documents[0]["source"] and "error" in ask("resources/read", uri="glosspan://chunks/none")
    prompt = ask("prompts/get", name="compare_documents", arguments={"first": documents[0]["source"], "second": documents[1]["source"]})["result"]["messages"][0]["content"]["text"]
    assert documents[0]["source"] in prompt and documents[1]["source"] in prompt and "error" in ask("prompts/get", name="summarize_document", arguments={"source": "none"})
    out = io.StringIO()
    server.run(['{"jsonrpc": "2.0", "id": 7, "method": "ping"}', "", "no json", '{"jsonrpc": "2.0", "method": "notifications/initialized"}', '{"id": 8, "method": "none"}'], out)
    assert [json.loads(line).get("error", {}).get("code") for line in out.getvalue().splitlines()] == [None, -32700, -32601]


def test_command_line_reports(engine, tmp_path, capsys, monkeypatch):
    index = engine.options.index_path
    assert cli.main(["--index", index, "report", "container image", "-o", str(tmp_path / "r.html")]) == 0 and (tmp_path / "r.html").read_text().startswith("<!doctype html>")
    assert cli.main(["--index", index, "report", "container image", "-o", str(tmp_path / "r.md")]) == 0 and (tmp_path / "r.md").read_text().startswith("# container image")
    assert cli.main(["--index", index, "dashboard", "--html", str(tmp_path / "d.html")]) == 0
    assert cli.main(["--index", index, "compare", "container", "top_k=1"]) == 0 and "overlap" in capsys.readouterr().out
    assert cli.main(["--index", index, "compare", "container", "nothing=1"]) == 2 and cli.main(["--index", index, "search", " "]) == 2 and cli.main(["--index", index, "search", "x", "-k", "0"]) == 2
    monkeypatch.chdir(tmp_path)
    (tmp_path / "glosspan.toml").write_text(f'index_path = "{index}"\n')
    assert cli.main(["search", "installer"]) == 0 and cli.main(["--index", str(tmp_path / "none"), "search", "installer"]) == 1
    assert cli.logged("e", a="x", b="two words", c="") == 'e a=x b="two words" c=""'


def test_self_contained_report(spark, engine):
    made = engine.answer("container image")
    texts = {r.source: r for r in engine.cited_texts(made).collect()}
    first = made.passages.orderBy("rank").first()
    segment = texts[first.source].segments[0]
    assert 1 in segment.ranks and texts[first.source].text[segment.start : segment.end].split() == first.text.split()
    marks = [texts[first.source].text[segment.start + h.start : segment.start + h.end] for h in segment.highlights]
    assert set(marks) <= {"container", "image", "Container", "Image"} and marks
    page = reports.answer(engine, "container image", form="self-contained").content
    assert 'href="#inlined-1"' in page and '<span id="inlined-1"></span>' in page and "Delete the folder." in page and "file://" not in page.split("Cited texts")[0]
    # A document that has gone is linked instead.
    gone = answers.Answer("q", "a [1]", made.passages.withColumn("source", F.lit("/gone/away.txt")), None, None)
    assert engine.cited_texts(gone).isEmpty() and "away.txt" in html.self_contained(gone, engine.cited_texts(gone))


def test_passage_links(spark):
    rows = spark.createDataFrame([("/a b/n.md", None), ("/a/p.pdf", 3), ("/a/p.docx", None), ("https://e.org/x", None), ("https://e.org/x#y", None), ("/a/n.txt", 2)], "source string, first_page int")
    made = rows.select("source", T.passage_href(F.lit("one two-three"), F.array().cast("array<struct<start:int,end:int,term:string>>")).alias("href")).collect()
    assert [r.href for r in made] == ["file:///a%20b/n.md#:~:text=one%20two%2Dthree", "file:///a/p.pdf#page=3", "file:///a/p.docx", "https://e.org/x#:~:text=one%20two%2Dthree", "https://e.org/x#y", "file:///a/n.txt#page=2"]


def test_served_documents(engine, tmp_path):
    api = http.Api(engine)
    get = lambda **asked: api.handle("GET", f"/ui/source?{urllib.parse.urlencode(asked)}")
    found = engine.search("container image").first()
    assert b'<section id="passage">' in get(path=found.source, chunk=found.id, terms="image")[2] and b"Uninstall" in get(path=found.source)[2]
    page = next(r.source for r in engine.index().sources().collect() if r.source.endswith(".html"))
    status, kind, content = get(path=page)
    assert (status, kind) == (200, "text/html") and b"<main>" in content and http.guards(kind)["Content-Security-Policy"] == "sandbox"
    assert [get(path=p)[0] for p in ("/etc/hostname", "https://e.org/a", "")] == [404, 404, 404] and http.guards("application/json") == {}


def test_replaceable_parts(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one two three")
    (tmp_path / "d" / "b.pdf").write_bytes(b"first page|second page")
    ports = Ports(
        highlight=lambda text, terms, tokenizer=None: F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("term"))),
        locate=lambda: F.concat(F.lit("app:"), F.col("id")),
        chunk=lambda rows, size, overlap: chunking.windows(rows, 2, 0),
        parsers={"text": files.PARSERS["text"]} | {"pdf": lambda content, name: files.paged(content.decode().split("|"))},
        estimate=lambda usage: 7.0,
        renderers={("answer", "plain"): lambda made: f"{made.question}: {made.text}"},
        generate=lambda question, passages: answers.Generated("said", answers.Usage("m")),
    )
    engine = Engine(spark, settings.Settings(index_path=str(tmp_path / "ix")), clock=lambda: "now", ports=ports)
    assert engine.index_paths(str(tmp_path / "d")).chunks == 4
    found = engine.search("three").first()
    assert (found.text, found.href, found.highlights[0].term) == ("three", f"app:{found.id}", "x")
    page = engine.search("second").first()
    assert (page.text, page.first_page, page.last_page) == ("second page", 2, 2)
    assert engine.answer("three").cost_usd == 7.0 and reports.answer(engine, "three", form="plain").content == "three: said"


def test_reports_open_in_a_browser(engine, tmp_path, capsys, monkeypatch):
    opened = []
    monkeypatch.setattr(cli.webbrowser, "open", lambda uri: opened.append(uri) or len(opened) == 1)
    for _ in range(2):
        assert cli.main(["--index", engine.options.index_path, "report", "container image", "--format", "self-contained", "--open"]) == 0
    assert all(u.startswith("file://") and u.endswith("answer.html") for u in opened) and "no browser" in capsys.readouterr().err
    assert cli.main(["--index", engine.options.index_path, "report", "container image", "--format", "markdown"]) == 0 and "# container image" in capsys.readouterr().out
