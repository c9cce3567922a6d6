"""HTML, DOCX and Markdown against stored expectations."""

import random
import re

import pytest

from glosspan.operators import chunking
from glosspan.sources import docx, html

PAGE = """<!doctype html><html><head><title>Notes &amp; more</title><style>p {}</style><script>let a = "<p>no</p>";</script></head>
<body><header>Top</header><nav><ul><li>Docs</ul></nav>
<main><h1>One</h1><p>First   line<br>second <b>bold</b> line.<p># 1 of many
<table><tr><th>Name<th>Size</tr><tr><td>a</td><td>1</td></tr></table>
<pre>
# kept
  as is
</pre><h2>Two <small>(b)</small></h2><form>Sign up</form>end</main>
<aside>Also read</aside><noscript>Turn it on</noscript></body></html>"""


def test_page():
    inside = ["# One", "First line", "second bold line.", "\\# 1 of many", "Name Size", "a 1", "```\n# kept\n  as is\n```", "## Two (b)"]
    assert html.main_content(PAGE) == html.Page("\n\n".join([*inside, "end"]), "Notes & more")
    assert html.whole(PAGE).text == "\n\n".join(["Top", "Docs", *inside, "Sign up", "end", "Also read"])


@pytest.mark.parametrize(
    ("markup", "main", "whole"),
    [
        ("<div>x</div><article>a<p>b</article>y<article>c</article>", "a\n\nb\n\nc", "x\n\na\n\nb\n\ny\n\nc"),
        ("<main><nav>m</nav></main><p>real", "real", "m\n\nreal"),
        ("a<nav>b</div>c", "a", "a\n\nb\n\nc"),
        ("<h3>a <p>b</p> c</h3>d", "### a b c\n\nd", "### a b c\n\nd"),
        ("<p>a<script>x</script>b<p>#c<p>####### d", "ab\n\n#c\n\n####### d", "ab\n\n#c\n\n####### d"),
        ("<svg><p>x</svg></p>y<br/>z", "y\n\nz", "y\n\nz"),
        ("", "", ""),
    ],
)
def test_markup(markup, main, whole):
    assert (html.main_content(markup).text, html.whole(markup).text) == (main, whole)


def test_deep_and_open_markup_takes_linear_time():
    deep = "<div><img><p>" * 60_000 + "x"
    assert html.whole(deep).text == "x"
    assert html.whole("</p>" * 50_000 + "<nav>" * 50_000 + "y").text == "y"


def test_sections_against_a_walk_over_lines():
    def walked(text):
        mark, path, out = None, {}, [("", [])]
        for line in text.splitlines():
            found = re.fullmatch(r" {0,3}(#{1,6})(?:[ \t]+)(\S.*?)(?:[ \t]+#+)?[ \t]*", line)
            if found and not mark:
                path = {k: v for k, v in path.items() if k < len(found[1])} | {len(found[1]): found[2]}
                out.append((" > ".join(path.values()), []))
            kind = line.strip()[:3]
            if kind in ("```", "~~~"):
                mark = kind if not mark else None if mark == kind else mark
            out[-1][1].append(line)
        return [(p, "\n".join(ls)) for k, (p, ls) in enumerate(out) if any(x.strip() for x in ls[k > 0 :])]

    rng = random.Random(4)
    lines = ["# a", "## b ##", "### c", "   # d", "    # e", "#f", "# #", "text", "", "```", "~~~", "``` py", "####### g", "#\th #"]
    for _ in range(3000):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))
        assert chunking.sections(text) == walked(text), text
    assert chunking.sections("") == []


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, inner=""):
    return f"<w:p>{f'<w:pPr>{inner}</w:pPr>' if inner else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx_body():
    style = lambda key, name, more="": f'<w:style w:type="paragraph" w:styleId="{key}"><w:name w:val="{name}"/>{more}</w:style>'
    styles = f"""<w:styles {W}>{style("T1", "Heading 2")}{style("C", "Chapter", '<w:pPr><w:outlineLvl w:val="0"/></w:pPr>')}
      {style("D", "Derived", '<w:basedOn w:val="C"/>')}{style("X", "x", '<w:basedOn w:val="Y"/>')}{style("Y", "y", '<w:basedOn w:val="X"/>')}
      <w:style w:type="character" w:styleId="Z"><w:name w:val="heading 1"/></w:style></w:styles>"""
    assert docx.style_levels(styles.encode()) == {"T1": 2, "C": 1, "D": 1}
    use = lambda key: f'<w:pStyle w:val="{key}"/>'
    cell = lambda *inner: f"<w:tc>{''.join(inner)}</w:tc>"
    parts = [paragraph("Top", use("D")), paragraph("Sub  title", use("T1")), paragraph("# plain"), "<w:p/>", paragraph("loop", use("X"))]
    parts += [paragraph("Deep", '<w:outlineLvl w:val="2"/>'), paragraph("Body", '<w:outlineLvl w:val="9"/>'), paragraph("Built in", use("Heading3"))]
    parts += [f"<w:tbl><w:tr>{cell(paragraph('a'), paragraph('b'))}{cell(paragraph(''))}{cell(paragraph('c'))}</w:tr></w:tbl>", "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/></w:r><w:r><w:t>z</w:t></w:r></w:p>"]
    body = f"<w:document {W}><w:body>{''.join(parts)}<w:sectPr/></w:body></w:document>"
    assert docx.body_text(body.encode(), styles.encode()).split("\n\n") == ["# Top", "## Sub title", "\\# plain", "loop", "### Deep", "Body", "### Built in", "a b | c", "x y z"]
