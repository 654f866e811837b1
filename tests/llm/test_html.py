import html as entities
import re

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.html import Page, extract_text, node_densities, op2_html


def expected(source):
    """The made pages have one article with h1 and p blocks."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark):
    rows = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op2_html(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == expected(rows[r.page_id].html), rows[r.page_id].html
        assert r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_density_finds_the_same_without_the_tag(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = r.html.replace("<article>", "<div class='content has-sidebar'>").replace("</article>", "</div>")
        assert Page(plain).text() == expected(r.html), r.html


LONG = "This is a sentence of the main story, and it goes on for quite a while. " * 4


def test_kinds_of_pages():
    page = f"""<html><body><header><h1>Site</h1><a href=/>Home</a></header><div class="cookie-notice">We use cookies {LONG}</div>
    <div id=wrap><div class=sidebar><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=content><h2>Title &amp; more</h2>
    <p>First {LONG}<p>Second <b>bo</b>ld<br>line {LONG}</p><blockquote>Quoted {LONG}</blockquote><table><tr><td>a<td>b<tr><td>c</table>
    <form><input name=q>Search {LONG}</form><p>End.</p></div></div><section id="comments"><p>Reader says {LONG}</p></section>
    <footer>&copy; 2020</footer><script>document.write("<p>no</p>")</script></body></html>"""
    long = LONG.strip()
    assert Page(page).text().split("\n") == ["Title & more", f"First {long}", f"Second bold line {long}", f"Quoted {long}", "a b", "c", "End."]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<div>a<p>b</p>c</div>", "a\nb\nc"), ("<p>x < y &lt; z &#233;&nbsp;&am</p>", "x < y < z é &am"),
        ("<p>cut <b off", "cut"), ("<!-- c --><p>a<!-- <p>no --></p>", "a"), ("<p title='a>b'>q</p>", "q"), ('<p title="a>q</p>', "q"), ("</div><p>s</b></i>t", "st"),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", "1\n2\n3\n4"), ("<style>p{}</style><script>x</scr</script>t", "t"), ("<nav>n</nav>", ""), ("<p hidden>h</p><p>v</p>", "v"),
    ],
)
def test_markup(source, text):
    assert Page(source).text() == text


def test_hard_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>abc", "x"), (1, "u", None, "x"), (3, "u", "<div>" * 3000 + "deep" + "<b>" * 3000, "x"), (4, "u", "<p>" + "w " * 300_000, "x"), (5, "u", "<" * 20_000 + '<a "' * 3000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text) for r in extract_text(pages).collect() if r.page_id != 5}
    assert got == {(1, ""), (2, ""), (None, "abc"), (3, "deep"), (4, ("w " * 300_000).strip())}
    assert extract_text(pages.limit(0)).count() == 0
    nodes = node_densities(pages.where("page_id IS NULL")).collect()
    assert [(n.node, n.tag) for n in nodes] == [(0, "#root"), (1, "p")] and nodes[1].density > 0


@pytest.mark.parametrize("mark", ["div class='content has-sidebar'", "div class='entry-content share-enabled'", "article class='post ad-free'", "article class=comment", "div id=noSidebar", "div class='page-with-comments'", "div class='sidebar-layout'"])
def test_names_that_dont_mark_a_part(mark):
    tag, other = mark.split()[0], f"<div class=side-menu>Menu {LONG}</div><div class='post-comments'>Reader {LONG}</div>"
    page = f"<html><body>{other}<{mark}><h1>Title</h1><p>First {LONG}</p><p>Second {LONG}</p><p>Third {LONG}</p></{tag}></body></html>"
    assert Page(page).text().split("\n") == ["Title", *(f"{x} {LONG.strip()}" for x in ("First", "Second", "Third"))]


def test_long_comments_beside_an_article():
    page = f"<body><article><p>Story {LONG}</p></article><div id=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    assert Page(page).text() == f"Story {LONG.strip()}"


def lines(*texts):
    return "\n".join(" ".join(t.split()) for t in texts)


def wrapped(inner, tag="article"):
    return f"""<html><head><title>T</title></head><body><header><a href=/>Home</a></header><nav><a href=a>One</a><a href=b>Two</a></nav>
    <div id=page><aside>About us {LONG}</aside><{tag}>{inner}</{tag.split()[0]}></div><div class=related-posts><a href=1>More {LONG}</a></div><footer>End of page</footer></body></html>"""


PARAS = [f"Paragraph {k}: {LONG}" for k in range(14)]
SECTIONS = "".join(f"<section><h2>Part {a}</h2>{''.join(f'<p>{p}</p>' for p in PARAS[a:b])}</section>" for a, b in ((0, 2), (2, 13), (13, 14)))
WHOLE = {
    "sections": (f"<h1>Title</h1><p class=lead>A short lead.</p><p class=author>By A. Uthor</p>{SECTIONS}", lines("Title", "A short lead.", "By A. Uthor", "Part 0", *PARAS[:2], "Part 2", *PARAS[2:13], "Part 13", PARAS[13])),
    "list": ("<h1>Title</h1><p>Short intro.</p><ul>" + "".join(f"<li>{p}" for p in PARAS[:9]) + "</ul><p>Bye now.</p>", lines("Title", "Short intro.", *PARAS[:9], "Bye now.")),
    "quote": ("<h1>Title</h1><p>Short intro.</p><blockquote>" + "".join(f"<p>{p}</p>" for p in PARAS[:9]) + "</blockquote><p>Bye now.</p>", lines("Title", "Short intro.", *PARAS[:9], "Bye now.")),
    "table": ("<p>Short intro.</p><table>" + "".join(f"<tr><td>{k}<td>{p}" for k, p in enumerate(PARAS[:9])) + "</table><p>Bye now.</p>", lines("Short intro.", *(f"{k} {p}" for k, p in enumerate(PARAS[:9])), "Bye now.")),
    "line": ("<p>One short line.</p>", "One short line."),
    "comments inside": (f"<h1>Title</h1><p>{PARAS[0]}</p><section class=comments>" + "".join(f"<p>{p}</p>" for p in PARAS) + "</section>", lines("Title", PARAS[0])),
}


@pytest.mark.parametrize("kind", WHOLE)
def test_whole_articles(kind):
    inner, want = WHOLE[kind]
    assert Page(wrapped(inner)).text() == want


@pytest.mark.parametrize("kind", ["sections", "list", "quote", "table", "comments inside"])
def test_whole_articles_in_a_plain_element(kind):
    inner, want = WHOLE[kind]
    assert Page(wrapped(inner, "div class=story")).text() == want


def test_sections_that_are_plain_elements():
    parts = "".join(f"<div class=part id=p{a}><h2>Part {a}</h2>{''.join(f'<p>{p}</p>' for p in PARAS[a:b])}</div>" for a, b in ((0, 6), (6, 13))) + "<div class=part id=z><p>So be it.</p></div>"
    assert Page(wrapped(f"<h1>Title</h1>{parts}", "div")).text() == lines("Title", "Part 0", *PARAS[:6], "Part 6", *PARAS[6:13], "So be it.")


@pytest.mark.parametrize("around", ["section class=discussion", "div", "section"])
def test_comment_blocks_beside_an_article(around):
    page = wrapped("<p>One short line.</p>").replace("<footer>", f"<{around}>" + "".join(f"<p>{p}</p>" for p in PARAS[:10]) + f"</{around.split()[0]}><footer>")
    assert Page(page).text() == "One short line."


@pytest.mark.parametrize(
    "source",
    ["<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000 + "x", "<b>" * 20_000 + "<br>" * 20_000, "<div class=menu>" * 10_000 + "x" + "<article>y</article>" * 10_000, "<p><b>" * 20_000, "<a '>" * 20_000, "<ul><li>" * 10_000 + "w"],
)
def test_hostile_pages_take_linear_time(source):
    import time

    began = time.process_time()
    Page(source).text()
    assert time.process_time() - began < 2
