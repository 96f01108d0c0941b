from __future__ import annotations

import html
import re
import time

import pytest

from quotaflow.llm.html import extract_text, op1_html_extraction, parse
from helpers import PAGES, SMALL, collected

pytestmark = pytest.mark.usefixtures("spark")


def text(page, templates=frozenset()):
    return "\n".join(parse(page, templates)[0])


def test_parts_that_are_not_the_article():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav>Menu</nav>
      <div class="cookie-notice">Cookies</div><main><article><header><h1>Head &amp; tail</h1></header><p>One  two<br>three
      <b>bold<p>Second &lt;p&gt; 1 < 2<!-- no --></p><div class="ad">Buy</div><aside>Side</aside><form>Mail</form>
      <ul><li>a<li>b</ul><style>p{}</style></article><section id="comments"><article class="comment">Me too</article></section></main>
      <footer>Foot</footer></body></html>"""
    assert text(page) == "Head & tail\nOne two three bold\nSecond <p> 1 < 2\na\nb"


def test_classes_that_only_share_a_word_with_a_box_stay():
    parts = ['<header class="entry-header"><h1>Head</h1></header>', '<div class="article-header">Line</div>',
             '<div class="elementor-widget text"><p>Body</p></div>', '<section class="related-work">Others</section>',
             '<section id="social-history">Past</section>', '<div class="notice-of-meeting">At six</div>',
             '<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding="tex">x=1</annotation></math></p>']
    boxes = '<div class="ad">Buy</div><div class="wide cookie-notice">Cookies</div><div id="newsletter">Mail</div><ul class="share-buttons"><li>Share</ul>'
    want = "Head\nLine\nBody\nOthers\nPast\nAt six\nSo x=1"
    for root in ("article", "main"):
        assert text(f"<body class='x'><div class='no-sidebar'><{root} class='post comment-open'>{''.join(parts)}{boxes}<section class='comments'>Me too</section></{root}></div></body>") == want
    assert text(f"<body><div class='header'>Site</div><div class='body'>{''.join(parts[1:])}{boxes}</div></body>") == want[5:]


@pytest.mark.parametrize("attrs", ['title="a hidden gem"', 'data-note="the hidden truth"', 'hiddenish="1"', "title='class=ad'", "data-class=ad", "title=it's",
                                   'class="comment-open"', 'data-role="menu"', 'title="display:none"', 'alt="1 > 0"', "style='display:block'"])
def test_attributes_that_say_nothing(attrs):
    for tag in ("div", "p", "section"):
        assert text(f"<article><{tag} {attrs}>Don't go</{tag}><p>on</article>") == "Don't go\non"


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", 'aria-hidden="true"', "role=navigation", "style='color:red; display : none'", 'class="notice"', 'class="wide promo"',
                                   "class=ad-inline", 'class="advert-inline"', 'class="user-comments"', 'id="reader-comments"', 'class="comment-thread"', "title='x' class='a&#100;'"])
def test_boxes_inside_an_article(attrs):
    for tag in ("div", "section"):
        assert text(f"<article><p>Text</p><{tag} {attrs}><p>Box</p></{tag}><p>on</article>") == "Text\non"


def test_deep_nesting_takes_time_in_proportion():
    def seconds(n, shape):
        page = shape(n)
        start = time.process_time()
        blocks, hashes = parse(page)
        assert len(blocks) >= n and hashes
        return time.process_time() - start

    for shape in (lambda n: "<article>" + "<div>word " * n + "</div>" * n, lambda n: "<div>" * n + "<p>word</b></i></form>" * n, lambda n: "<svg>a<p>" * n):
        seconds(1000, shape)
        assert seconds(8000, shape) < 1  # 3.4 s with a hash of each element's whole text


def test_nested_hashes_tell_subtrees_apart():
    def hashes(page):
        return set(parse(page)[1])

    assert hashes("<div><p>a</p><p>b</p></div>") & hashes("<section><div><p>a</p><p>b</p></div>c</section>")
    assert len(hashes("<div>a<ul><li>b</li></ul></div><div>b<ul><li>a</li></ul></div>")) == 6
    assert not hashes("<div>a b</div>") & hashes("<div>a<br>b c</div>") and not hashes("<div>a</div>") & hashes("<ul>a</ul>")
    whole, part = parse("<div>x<div>y</div></div>")[1], parse("<div>y</div>")[1]
    assert text("<div>x<div>y</div></div><p>z", frozenset(whole)) == "z" and text("<div>x<div>y</div></div><p>z", frozenset(part)) == "x\nz"


def test_elements_whose_end_is_missing():
    assert text("<p>a<svg/>b<svg><path/></svg>c<p>d<object>e") == "a b c\nd e"
    assert text("<p>a<script>b") == "a"


def test_without_root_whole_body_counts():
    assert text("<p>a</p><div>b<div>c</div>d</div>") == "a\nb\nc\nd"
    assert text("plain  text &eacute;&#233;&nope;") == "plain text éé&nope;"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p>", "<!-- open", "<script>x", "<p>" * 3000, "&" * 50, "<a href='x", "<<<>>>"])
def test_odd_pages(page):
    assert isinstance(text(page), str)


def test_long_page():
    assert text("<article>" + "<p>word </p>" * 50_000) == "\n".join(["word"] * 50_000)


def test_templates_are_per_host_and_articles_stay(spark):
    box = "<div><p>All about this site</p></div>"
    rows = [(i, f"http://{'a' if i < 8 else 'b'}.org/{i}", f"{box}<div><p>Text {i}</p></div>") for i in range(9)]
    rows += [(20 + i, f"http://c.org/{i}", "<article><p>The same line</p></article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(8)] == [f"Text {i}" for i in range(8)]
    assert got[8] == "All about this site\nText 8"  # one page of its host only
    assert all(got[20 + i] == "The same line" for i in range(9))


def test_a_template_with_own_text_and_nested_templates_goes_whole(spark):
    box, inner = "<div>About us: <p>We sell tea</p></div>", "<div><p>Subscribe</p><ul><li>by mail</li></ul></div>"
    rows = [(i, f"http://a.org/{i}", f"{box}<div>Text {i}</div>") for i in range(6)]
    rows += [(10 + i, f"http://b.org/{i}", f"<article><p>Text {i}</p>{inner}</article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {at + i: f"Text {i}" for at in (0, 10) for i in range(6)}


def test_copies_of_a_page_are_not_recurrence(spark):
    def body(i):
        return f"<div><h1>Head {i}</h1><div><p>Text {i}</p><ul><li>Point {i}</li></ul></div></div>"

    rows = [(i, f"http://a.org/{i}", body(max(i, 10)) + "<div>Box</div>") for i in range(30)]  # 11 copies
    rows += [(40, "http://a.org/0", body(10) + "<div>Box</div>")] * 3
    rows += [(50 + i, f"http://b.org/{i}", f"<article>{body(max(i, 10))}</article>") for i in range(30)]
    got = [(r["page_id"], r["text"]) for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()]
    assert len(got) == len(rows)
    for i, t in got:
        n = 10 if i == 40 else max(i % 50, 10)
        assert t == f"Head {n}\nText {n}\nPoint {n}", i


def test_boxes_on_a_section_of_a_large_host(spark):
    box = "<div><p>Notice of the section</p></div>"
    rows = [(i, f"http://a.org/{i}", f"{box if i % 10 == 0 else ''}<div><p>Text {i}</p>{'<p>Rare</p>' if i % 100 == 0 else ''}</div>") for i in range(400)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Text {i}" + "\nRare" * (i % 100 == 0) for i in range(400)}


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(None, None, None), (1, "x", "<p>a"), (1, "x", "<p>a"), (2, None, "<p>b")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'q' AS host", "1 AS hashes", "'z' AS text", "2 AS n_chars")
    got = collected(extract_text(pages), "page_id")
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(None, "", 0), (1, "a", 1), (1, "a", 1), (2, "b", 1)]
    assert extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_query_against_a_plain_reading_of_these_pages(spark):
    def plain(page):
        body = page.split("<article>")[1].split("</article>")[0]
        return "\n".join(t for x in re.split(r"</?(?:p|h1)>|<br>", body) if (t := " ".join(html.unescape(re.sub(r"</?b>", "", x)).split())))

    want = {r["page_id"]: plain(r["html"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = op1_html_extraction(spark, SMALL).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
