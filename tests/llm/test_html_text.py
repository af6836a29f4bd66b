"""Operator 13: hand-written pages, broken ones, and the given ones against a plain reading of their known form."""

import html
import random
import re
import time

import pytest

from framestride.llm import html_text
from framestride.llm.html_text import main_text

LOREM = "The long river runs slowly past the old town, where boats wait for the morning and nobody counts the hours. "
P1, P2, P3 = LOREM * 3, "Short one.", LOREM * 2 + "Ends &amp; stays: 3 &lt; 5."
WANT = [" ".join(P1.split()), P2, (LOREM * 2 + "Ends & stays: 3 < 5.").strip()]


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def blocks(*texts):
    return "\n\n".join(texts)


MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(8)) + "</ul>"
COMMENTS = '<section class="comments"><h2>Comments</h2>' + "".join(f'<div class="comment"><p>{LOREM * 4} says reader {i}</p></div>' for i in range(6)) + "</section>"

PAGES = {
    "plain article": (f"<nav>{MENU}</nav><article><h1>A title</h1>{paragraphs(P1, P2, P3)}</article><footer>&copy; all</footer>", ["A title", *WANT]),
    "no article element": (f'<div id="top-nav">{MENU}</div><div class="story">{paragraphs(P1, P2, P3)}</div><div class="sidebar">{paragraphs(LOREM, LOREM)}</div>', WANT),
    "no names at all": (f"<div>{MENU}</div><div><div>{paragraphs(P1, P2, P3)}</div><div>{MENU}</div></div><div><a href='/'>Back</a> | <a href='/x'>Imprint</a></div>", WANT),
    "notice, form, advert and aside inside": (
        f'<div class="cookie-notice">{paragraphs(LOREM)}<button>Yes</button></div><main><article><header><h1>T</h1></header><p>{P1}</p><div class="ad-slot">Buy <b>now</b></div><aside><p>{LOREM}</p></aside>'
        f'<p>{P2}</p><form action="/s"><label>Mail</label><input name="m"><p>Join</p></form><p>{P3}</p></article>{COMMENTS}</main>', ["T", *WANT]),
    "comments longer than the article": (f'<article><h1>T</h1><p>{P2}</p></article>{COMMENTS}<article class="comment"><p>{LOREM * 9}</p></article>', ["T", P2]),
    "two sections": (f"<div>{MENU}</div><div class='text'><h1>T</h1><section><h2>One</h2>{paragraphs(P1, P2)}</section><section><h2>Two</h2>{paragraphs(P3)}</section></div>", ["T", "One", *WANT[:2], "Two", WANT[2]]),
    "heading before the text": (f"<header><a href='/'>Site</a></header><h1>T</h1><div>{paragraphs(P1, P2, P3)}</div><div>{MENU}</div>", ["T", *WANT]),
    "unclosed tags": (f"<article><h1>T</h1><p><b>{P1}<br><p>{P2}<ul><li>a<li>b <i>c</ul><p>{P3}", ["T", WANT[0], P2, "a", "b c", WANT[2]]),
    "inline and block": ("<article><div>one <b>t</b>wo<p>three</p>four<br>five <script>var a = '<p>';</script>six<p></p>seven&nbsp;\n eight</div></article>", ["one two", "three", "four five six", "seven eight"]),
    "table": ("<article><table><tr><td>a<p>b<td>c<tr><th>d</table><p>e</article>", ["a", "b", "c", "d", "e"]),
    "hidden parts": ('<article><p hidden>x</p><p style="display: none">y</p><p aria-hidden="true">z</p><!-- <p>c</p> --><p>seen</p><noscript>no</noscript><template><p>t</p></template></article>', ["seen"]),
    "marks do not hide what holds the article": (f'<form id="aspnet"><div class="page has-sidebar header-fixed"><h1>T</h1>{paragraphs(P1, P2)}</div></form>', ["T", *WANT[:2]]),
    "code": ('<article><p>Run <code>a <span class="comment"># all</span></code></p><h2 class="section-header" id="search">S</h2></article>', ["Run a # all", "S"]),
    "one word": ('<div class="ad">Nicht aulich</div><article><h1>Be</h1></article><footer>f</footer>', ["Be"]),
    "menu inside": (f"<article><p>{P1}</p>{MENU}<p>{P2}</p></article>", WANT[:2]),
    "text in the body": ("just words<br>and more", ["just words and more"]),
    "references": ("<article><p>&#65;&#x42;&#0;&hellip;&notit;&amp</p></article>", ["AB�…¬it;&"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    body, want = PAGES[name]
    assert main_text(body) == blocks(*want)
    if "unclosed" not in name and "table" not in name:
        assert main_text(f"<!DOCTYPE html><html><head><title>x &amp; y</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='header'>{body}</body></html>") == blocks(*want)


def test_nothing_to_read():
    for page in (None, "", " \n", "<html></html>", "<div", "<!-- never closed", "<script>x", "<nav>menu</nav>", "<p a='"):
        assert main_text(page) == ""
    assert main_text("a < b") == "a < b"


def test_broken_pages_never_fail():
    rng = random.Random(13)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x", ">", "text ", "<!--", "-->", "<table>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "&am", "&#", "<", "</", "<b>", "</body>", "<head>", "<title>", "</title>", '"', "'", "=", "<article>", "é", "<br/>", "<script>", "</script>"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        t = html_text.parse(page)
        assert all(p < i for i, p in enumerate(t.parent)) and all(i < e <= len(t.tag) for i, e in enumerate(t.end))
        text = main_text(page)
        assert not re.search(r"\s\s(?<!\n\n)|^\s|\s$|\n\n\n", text)


def test_time_grows_with_length():
    for page in ("<div>" * 200_000 + "x", "<b>" * 50_000 + "<li>x" * 50_000, "</p>" * 300_000, "<p a=" * 60_000, '"<a "' * 60_000, "<!-" * 100_000, "<td>" * 100_000, "<p>" + "a<br>" * 200_000, "<article>" + f"<p>{LOREM}</p>" * 30_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 20


def test_given_pages_equal_a_plain_reading_of_their_form(spark):
    got = html_text.op13_html_text(spark, "/root/testdata/sf0.1").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>x"), (2, "u", "<article>" + f"<p>{LOREM}</p>" * 20_000 + "</article>"), (2, "u", "<p>é😀</p>"), (2, "u", "<p>é😀</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/a/pages.parquet")
    got = html_text.op13_html_text(spark, f"{tmp_path}/a").collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 2), (2, 2), (2, (len(LOREM.strip()) + 2) * 20_000 - 2)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert html_text.op13_html_text(spark, f"{tmp_path}/b").count() == 0
