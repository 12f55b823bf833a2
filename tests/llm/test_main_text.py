"""Main text of pages: a plain reading of the given template, and hosts with templates of their own."""

import html
import random
import re
import time

import pytest

from actloom.llm.html_tree import Page, tokens
from actloom.llm.main_text import Containers, host_of, main_text, op11_html_extraction

BLOCK = re.compile(r"</?(?:p|h1|div|ul|li|article)\b[^>]*>")


def article(page):
    """The given template's article, by patterns: nothing inside it is furniture."""
    found = re.search(r"<article>(.*)</article>", page, re.S)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in BLOCK.split(found.group(1)))
    return "\n".join(b for b in blocks if b)


def test_query_by_brute_force(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op11_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        want = article(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def own(page):
    found = Containers(page)
    return found.text(found.winner({}))


WORDS = "river stone under light every morning they walked along without hurry until evening came".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


FURNITURE = """<html><head><title>T</title><style>p{}</style><script>if (a<b) { x = "<p>no</p>"; }</script></head><body class="has-sidebar">
<header><h2>Site name</h2><nav><a href=/>Home</a> <a href=/b>B</a></nav></header>
<div class="cookie-notice">We use cookies. <button>Accept</button></div><!-- <p>not this</p> --><div id="adSlot3">Buy now</div>
<div class=sidebar><h3>Popular</h3><p>Something else to read, and more of it.</p></div>
<form action="/s"><label>Search</label><input name=q></form>%s
<section class="comments"><h3>Comments</h3><article class="comment"><p>First! A long comment by a reader of the site.</p></article></section>
<footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>One<br>two  &nbsp; three<p>Four &lt;five&gt;<ul><li>Six<li>Seven</ul></article>", "A & B\nOne two three\nFour <five>\nSix\nSeven"),
        ("<article><header><h1>Head</h1></header><p>Body text.</p><aside>Aside</aside><footer>Tags</footer></article>", "Head\nBody text."),
        ("<main><div class='article-header'><h1>Head</h1></div><div class=post-body><p>Body</p><div class='share'>Share it</div><p>text.</p></div></main>", "Head\nBody\ntext."),
        ("<article><p>Body &amp;amp; text.</p><h2>Comments (3)</h2><ul><li>Reader one</li></ul></article>", "Body &amp; text."),
        ("<article><p>5 < 6 and <b>bold<i>er</b></i> text</p><p hidden>no</p><p style='display: none'>no</p><table><tr><td>a<td>b</table></article>", "5 < 6 and bolder text\na\nb"),
        ("<article></article>", ""),
        ("<nav><ul><li><a href=/x>Left open<article><p>Body</p></article>", "Body"),
        ('<article><p title="a > b">Body</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>End</article>', "Body\nEnd"),
        ("<article><p>caf&eacute; &#233; &#x1F600; &unknown; R&D</p></article>", "café é 😀 &unknown; R&D"),
    ],
)
def test_furniture(body, want):
    filler = "" if want else ""
    found = Containers(FURNITURE % (body + filler))
    path = next((p for p in found.elements if found.name(p).endswith(("article", "main"))), found.winner({}))
    assert found.text(path) == want
    if len(want) > 40:
        assert own(FURNITURE % body) == want


def test_form_around_the_page():
    assert own("<body><form><input type=hidden><div><h1>Head</h1><p>Text of the page.</p></div></form></body>") == "Head\nText of the page."


@pytest.mark.parametrize(("page", "want"), [("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("a<!-- open", "a"), ("a<p", "a"), ("<script>x", ""), ("</p>x</div>", "x"), ("<!doctype html>\n x ", "x"), ("a < b <3 c", "a < b <3 c"), ("<!-->a", "a")])
def test_broken_pages(page, want):
    assert own(page) == want


def test_tokens_keep_text():
    rng = random.Random(3)
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</p>", "a", "<", ">", "&amp;", "<b x='>'>", "<!--", "-->", '"', "<br/>", "</", "<a href=\"x", "<script>", "</script>", " "]) for _ in range(12))
        list(tokens(page))
        Page(page)


def test_linear_time():
    for page in ("<div>" * 100_000, "<" * 300_000, "<a " * 100_000, "<p>x" * 100_000, '<a b="' * 50_000 + ">", "<b>" * 100_000 + "</b>" * 100_000, "<ul><li>x" * 50_000 + "</p>" * 50_000):
        began = time.time()
        own(page)
        assert time.time() - began < 8


@pytest.fixture(scope="module")
def hosts():
    """Hosts whose templates have unmarked furniture and odd class names; some pages have next to no text."""
    rng, rows = random.Random(5), []
    for i in range(60):
        title, text = prose(rng, 5), [prose(rng, 2 if i % 10 == 0 else 60) for _ in range(1 if i % 10 == 0 else 5)]
        side = prose(rng, 12)
        if i % 2:
            body = f"<div class=x{i}q><div class=zz><p>{side}</p></div><div class='m{i} kk'><h1>{title}</h1>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=yy>{side}</div></div>"
            rows.append((i, f"https://u@One.example.com:80/{i}", f"<body>{body}</body>", "\n".join([title, *text])))
        else:
            body = f"<table><tr><td class=l>{side}</td><td class=r>{''.join(f'<div class=part{j}>{t}</div>' for j, t in enumerate(text))}</td></tr></table><div>{side}</div>"
            rows.append((i, f"http://two.example.com/{i}", f"<body>{body}</body>", "\n".join(text)))
    return rows


def test_consensus(spark, hosts):
    pages = spark.createDataFrame([r[:3] for r in hosts], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in main_text(pages).collect()}
    assert {i: r.text for i, r in got.items()} == {r[0]: r[3] for r in hosts}
    assert {r.path for r in got.values()} == {"body > div.x#q > div.kk.m#", "body > table > tr > td.r > div.part#"}
    # short pages go wrong by themselves
    assert any(own(r[2]) != r[3] for r in hosts if r[0] % 10 == 0)


def test_hosts():
    assert [host_of(u) for u in ("http://A.b/c", "//x:1/", "https://u:p@h?q", "mailto:x", "", None, "/a//b")] == ["a.b", "x", "h", "", "", "", ""]


def test_edges(spark):
    schema = "page_id long, url string, html string, id string, host int, text int, path string, body binary, batch_id int"
    long = "<article>" + "<p>one two three</p>" * 300_000 + "</article>"
    data = [(1, "http://a/", None), (1, "http://a/", ""), (None, None, "<p>x</p>"), (None, None, "<p>x</p>"), (2, "http://a/2", long), (3, "", "<nav>n</nav>")]
    got = main_text(spark.createDataFrame([(*d, "i", 1, 2, "p", b"b", 3) for d in data], schema))
    assert got.columns == ["page_id", "url", "text", "n_chars", "path"]
    rows = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()), key=repr)
    assert rows == sorted([(1, "http://a/", "", 0), (1, "http://a/", "", 0), (None, None, "x", 1), (None, None, "x", 1), (2, "http://a/2", "\n".join(["one two three"] * 300_000), 300_000 * 14 - 1), (3, "", "", 0)], key=repr)
    assert main_text(spark.createDataFrame([], schema)).collect() == []
