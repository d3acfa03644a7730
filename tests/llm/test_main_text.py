"""Main text: planted templates against a plain extraction of the article, malformed pages, the whole query."""

import html as entities
import random
import re

import numpy as np
import pytest

from halocline.llm import main_text as mt
from halocline.llm import queries

PAGE = "page_id long, url string, html string"


def plain_article(html):
    """The blocks inside <article> of pages whose article holds headings and paragraphs only."""
    body = re.search(r"<article>(.*?)(</article>|$)", html, re.S)
    parts = re.split(r"</?(?:p|h\d)>", body[1] if body else "")
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_query_matches_a_plain_extraction(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.QUERIES["op13_main_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


JUNK = [
    "<nav><ul><li><a href=/>Home</a><li><a href=/a>About us and all that</a></ul></nav>",
    "<header><p>The site's own name, spelled out at some length</p></header>",
    "<aside>Something that the reader may like as well, in many words</aside>",
    '<div class="sidebar-left"><p>Long sidebar text that goes on and on and on for a while</p></div>',
    '<div id="cookie-notice">We use cookies on this page, as everybody does these days.</div>',
    '<div class="ad slot2">Buy this now, it is cheap and it is good and it is here</div>',
    "<form><p>Your name and address, please, in full</p><input><button>Send</button></form>",
    "<script>var t = '</p>long enough to be a paragraph of its own';</script>",
    "<style>p { margin: 0 }</style><noscript>Please switch on scripts to read this page</noscript>",
    '<section class="comments"><article><p>A reader has a lot to say on this, at length</p></article></section>',
    "<footer>All rights reserved by those who have them, everywhere</footer>",
    "<!-- a remark that is long enough to look like text -->",
]


def body_blocks(rng):
    word = lambda: rng.choice(["alpha", "beta,", "gamma.", "d&amp;e", "&eacute;t&#233;", "<b>bold</b>", "<a href=x>link</a>", "zeta\n"])
    return ["%s%s" % (" ".join(word() for _ in range(rng.choice([1, 2, 30, 80]))), rng.choice(["", " <br> end"])) for _ in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<div role=main>%s</div>", "<article><div>%s</div></article>"])
def test_junk_around_and_inside_an_article(around):
    rng = random.Random(5)
    for _ in range(60):
        blocks = body_blocks(rng)
        want = "\n".join(" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)
        inside = [rng.choice(["<p>%s</p>", "<p>%s", "<div>%s</div>", "<h2>%s</h2>", "<ul><li>%s</ul>"]) % b for b in blocks]
        for junk in rng.sample(JUNK, 5):
            inside.insert(rng.randrange(len(inside) + 1), junk)
        page = around % "".join(inside)
        outside = rng.sample(JUNK, 6)
        html = f"<!DOCTYPE html><html><head><title>Title</title></head><body class=has-sidebar>{''.join(outside[:3])}{page}{''.join(outside[3:])}</body></html>"
        assert mt.main_text(html) == want, html


def test_pages_without_a_labelled_article():
    long = "This is a paragraph with a good many words in it, so that it counts as content by itself. " * 3
    page = f'<body><div><a href=/>Home</a> <a href=/x>More</a> <a>All</a></div><div id=c><h2>Head</h2><p>{long}</p><p>Short.</p><ul><li>one<li>two</ul><p>{long}</p></div><div><a>Link</a><a>Link</a></div><div class="site-footer">foot</div>'
    assert mt.main_text(page).split("\n") == ["Head", long.strip(), "Short.", "one", "two", long.strip()]
    assert mt.main_text(f"<h1>Title</h1><p>{long}<p>two<p>{long}<ul><li><a>a</a><li><a>b</a></ul>").split("\n") == ["Title", long.strip(), "two", long.strip()]
    assert mt.main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert mt.main_text("<a>x</a>" * 30) == ""


def test_headers_in_articles_keep_headings_only():
    assert mt.main_text("<header><h1>Site</h1></header><article><header><h1>T</h1><p>by x</p></header><p>Text</p><footer>f</footer></article>") == "T\nText"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<nav><a>x</a><article><p>in a menu that never ends", "in a menu that never ends"),
        ("<article><p>cut sho", "cut sho"),
        ("<article></p></div>a</nowhere> b</article>", "a b"),
        ("<article>x<table><tr><td>a<td>b<tr><td>c</table>y</article>", "x\na\nb\nc\ny"),
        ("<article>&#xD800;&#0;&nbsp;z&bogus;</article>", "�� z&bogus;"),
        ("<ARTICLE><P/>A</ARTICLE>", "A"),
    ],
)
def test_odd_pages(html, want):
    assert mt.main_text(html) == want


def test_deep_and_long_pages():
    assert mt.main_text("<div>" * 20_000 + "deep") == "deep"
    assert mt.main_text("<article>" + "<p>word" * 20_000) == "\n".join(["word"] * 20_000)
    assert mt.main_text("<p>" + "</div></li></td>" * 20_000 + "x") == "x"


def test_smoothing_and_threshold():
    ratios = np.array([1.0, 2, 1, 90, 80, 3, 100, 1, 1, 1, 1])
    kernel = lambda d: np.exp(-d * d / 2.0) if abs(d) <= 2 else 0.0
    weight = np.array([[kernel(i - j) for j in range(len(ratios))] for i in range(len(ratios))])
    smooth = weight @ ratios / weight.sum(axis=1)
    content, cut = mt.content_lines(ratios)
    assert cut == pytest.approx(smooth.std()) and (content == (smooth >= smooth.std())).all()
    assert content[5] and not content[0] and not content[-1]
    assert mt.content_lines(np.ones(3))[0].all() and not len(mt.content_lines(np.zeros(0))[0])


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [(1, "u", "<article>a</article>", "t", 9), (1, "u", "<article>a</article>", "t", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, PAGE + ", text string, N_chars int").repartition(2)
    got = sorted(mt.extract_main_text(df).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [tuple(r) for r in got] == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert mt.extract_main_text(df.limit(0)).collect() == []
