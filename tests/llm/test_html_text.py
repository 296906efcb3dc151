import html as H
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from bookflow.llm import html_text
from tests.llm.helpers import LONG

TREE = html_text.train()


def text(page):
    return html_text.main_text(page, TREE)


def test_tree_fits_its_table():
    good = sum(html_text.decide(TREE, row[:-1]) == row[-1] for row in html_text.LABELLED)
    assert good >= 0.97 * len(html_text.LABELLED)
    assert html_text.used(TREE) >= {"words", "links", "links_before", "links_after", "words_before", "around", "inside", "beside"}


def test_wrappers_whose_names_tell_of_other_parts():
    long = " ".join(["word"] * 40)
    for name in ("with-sidebar", "has-sidebar", "content no-sidebar", "page-header-fixed", "layout sidebar", "post tag-python", "page has-banner", "widget-page"):
        for body in (f"<article><h1>T</h1><p>{long}</p><p>Short.</p></article>", f"<h1>T</h1><p>{long}</p><p>{long}</p>"):
            got = text(f"<div class='{name}'><nav><a href=/>Home</a></nav>{body}<div class=ad>Buy it</div></div><footer>by us</footer>")
            assert got.startswith(f"T\n\n{long}") and "Buy" not in got and "Home" not in got, (name, got)
    assert text(f"<div class='sidebar'><p>{long}</p></div><article><p>{long} one</p></article>") == f"{long} one"
    assert text(f"<article><p>Tiny.</p></article><div class='comments'><h2>C</h2><p>{long}</p><p>{long}</p></div>") == "Tiny."


def test_an_articles_own_header():
    page = "<header><h1>Site</h1></header><article><header><h1>Title</h1><p class=meta>By me, today</p></header><p>Body of it.</p><footer>shares</footer></article>"
    assert text(page) == "Title\n\nBody of it."
    assert text(page.replace("<article><header>", "<article><div class='entry-header'>").replace("</header><p>B", "</div><p>B")) == "Title\n\nBody of it."


def test_links_in_parts_named_like_a_text():
    long = " ".join(["word"] * 40)
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(6)) + "</ul>"
    assert text(f"<div id=content>{menu}<h1>T</h1><p>{long}</p><p><a href=x>A source of it</a></p><p>{long}</p>{menu}</div>") == f"T\n\n{long}\n\nA source of it\n\n{long}"
    assert text(f"<article><p>{long}</p>{menu}</article>").count("Part") == 6


def test_large_and_deep_pages():
    para = " ".join(["word"] * 30)
    assert text("<article>" + f"<p>{para}</p>" * 40_000 + "</article>") == "\n\n".join([para] * 40_000)
    assert text("<div>" * 20_000 + f"<article><p>{para}</p></article>") == para


def test_whole_pages_by_a_plain_model():
    """Random pages of parts whose place is sure: every paragraph of the article and nothing else comes out."""
    rnd = random.Random(8)
    some = lambda k: " ".join(rnd.choice(["one", "two", "é", "three"]) for _ in range(rnd.randint(1, k)))
    around = [lambda: f"<nav><ul><li><a href=/>{some(3)}</a></ul></nav>", lambda: f"<div class='ad'>{some(30)}</div>", lambda: f"<aside><p>{some(40)}</p></aside>", lambda: f"<footer>{some(20)}</footer>", lambda: f"<script>{some(9)}</script>", lambda: f"<form><p>{some(9)}</p></form>", lambda: f"<!-- {some(9)} -->", lambda: f"<section id=comments><p>{some(60)}</p></section>"]
    for _ in range(200):
        paras, inner = [], ""
        for _ in range(rnd.randint(1, 8)):
            paras.append(some(rnd.choice([2, 60])))
            tag = rnd.choice(["p", "div", "h2", "li", "blockquote"])
            inner += f"<{tag}>{paras[-1]}</{tag}>" + (rnd.choice(around)() if rnd.random() < 0.3 else "")
        page = "".join(rnd.choice(around)() for _ in range(rnd.randint(0, 3))) + f"<article>{inner}</article>" + "".join(rnd.choice(around)() for _ in range(rnd.randint(0, 3)))
        assert text(f"<html><body>{page}</body></html>") == "\n\n".join(paras), page


def test_parts_around_the_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <div class="cookie-notice"><p>We use cookies to make this long site better for all of its many readers, always.</p></div>
    <header class="site"><h1>The Site</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <article class="post"><h1>A &amp; B &mdash; caf&eacute;</h1><p>First <b>bold
       para</b>graph.<p>Be.</p><div class="ad">Buy this now</div><!-- no --><ul><li>item one<li>item <a href="x">two</a></ul>
    <blockquote>Said so.</blockquote><pre>code   here</pre><table><tr><td>cell</td><td>other</td></tr></table><aside>Side words of some length here.</aside>
    <form><label>Name</label><input><button>Send</button></form><p>Last&nbsp;one &#x1F600; &lt;tag&gt;<br>after break</p>
    <section id="comments"><h2>Comments</h2><article class="comment"><p>A reader has very many words to say about all of this here.</p></article></section></article>
    <div id="sidebar"><p>Some longer text that stands in the sidebar of the page, all the time.</p></div><footer>&copy; me</footer></body></html>"""
    want = ["A & B — café", "First bold paragraph.", "Be.", "item one", "item two", "Said so.", "code here", "cell", "other", "Last one \U0001f600 <tag> after break"]
    assert text(page) == "\n\n".join(want)


def test_pages_without_marks():
    long = " ".join(["word"] * 60)
    links = "".join(f'<a href="/{i}">link {i}</a> ' for i in range(5))
    assert text(f"<div>{links}</div><div><p>{long}</p><p>Short one here.</p><p>{long}</p></div><div>{links}</div>") == "\n\n".join([long, "Short one here.", long])


def test_forms():
    long = " ".join(["word"] * 60)
    assert text(f"<form><nav><a href=/>Home</a></nav><article><p>Body.</p><form><p>Your name</p></form></article></form>") == "Body."
    assert text(f"<form><div><p>{long}</p><p>{long}</p></div></form>") == f"{long}\n\n{long}"
    assert text(f"<div><p>{long}</p><form><p>{long}</p></form></div>") == long


def test_broken_markup():
    assert text("<article><p><b>One<br><p>Two</b> more<p>Three") == "One\n\nTwo more\n\nThree"
    assert text("<article><p>a < b & c &unknown; <3</article") != ""
    assert text("</div></p><article>x</article></article>") == "x"
    for page in (None, "", "  \n", "<", "<!--", "<script>", "<p", "&#0;"):
        assert isinstance(text(page), str)
    assert text(None) == text("") == text("<script>x</script>") == ""


def test_round_trip():
    """Paragraphs put into a page come out of it whole, in order."""
    rnd = random.Random(6)
    for _ in range(50):
        paras = [" ".join(rnd.choice(["a", "<b>", "&amp;", "é", "x&y", "\U00020b9f", "word", '"q"']) for _ in range(rnd.choice([1, 3, 40]))) for _ in range(rnd.randint(1, 12))]
        page = "<nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{H.escape(p)}</p>\n" for p in paras) + "</article><footer>by us</footer>"
        assert text(page) == "\n\n".join(paras)


def test_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = html_text.op9_html_text(spark, sf).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    odd = spark.createDataFrame([(1, None, "u", "clash", 1), (None, "", None, None, None), (2, f"<article>{LONG}</article>", "u", "clash", 2), (2, f"<article>{LONG}</article>", "u", "clash", 2)], "page_id long, html string, url string, text string, words int")
    got = html_text.extract(odd).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, len(LONG) - 1, len(LONG) - 1] and set(got[0].asDict()) == {"page_id", "url", "words", "text"}
    assert html_text.extract(odd.filter("page_id > 9")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><body><article><p>{}</p></article></body></html>",
        "<html><head><title>T</title><meta charset=utf-8><article><p>{}</p></article>",
        "<head><style>p {{}}</style><noscript><p>no script</p></noscript><script>x()</script><link rel=x><div><p>{}</p></div>",
        "<head><title>T</title>\n<article>{}</article>",
        "<html><body><article><button>Like<p>{}</p></article></body></html>",
    ],
)
def test_end_tags_left_out(page):
    text = "The river rose in the night and the men of the village went down to look at it before the sun was up."
    assert html_text.main_text(page.format(text), TREE) == text


def test_quotes_keep_their_names():
    assert text("<article><p>One.</p><blockquote class=related>Two.</blockquote><pre id=sidebar>Three.</pre><div class=related>Four.</div></article>") == "One.\n\nTwo.\n\nThree."


def unmarked(page):
    """The page with div for all elements that name a part, and without class, id and role."""
    page = re.sub(r"<(/?)(article|nav|main|aside|header|footer|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|\S+?(?=[\s>]))""", "", page)


def test_counts_densities_and_neighbours_decide(sf):
    """Where a page marks nothing, the tree finds its text by the method's own features, and does not without them."""
    pages = pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()[:100]
    want = [text(p) for p in pages]

    def found(*without):
        """The shares of the words found that are text, and of the text's words that are found, by a tree taught without some features."""
        rows = np.array(html_text.LABELLED, float)
        rows[:, [html_text.FEATURES.index(f) for f in without]] = 0
        tree = html_text.train(rows)
        size = lambda blocks: sum(len(b.split()) for b in blocks)
        got = [[b for b in html_text.main_text(unmarked(p), tree).split("\n\n")] for p in pages]
        own = [w.split("\n\n") for w in want]
        good = sum(size(b for b in g if b in set(w)) for g, w in zip(got, own, strict=True))
        return got, good / size(b for g in got for b in g), good / size(b for w in own for b in w)

    blocks, precision, recall = found()
    assert precision > 0.94 and recall > 0.99
    assert found("words", "links")[2] < 0.8
    fewer = found("words_before", "links_before", "words_after", "links_after")
    assert fewer[0] != blocks and fewer[2] < recall
