"""Main text: least cuts against all labellings, pages against texts planted in them, the query against the markers of its pages."""

import html as markup
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docketry.llm import html_extraction as H
from docketry.llm.queries import op13_html_extraction

SF = "/root/testdata/sf0.01"
NONE = [0.0] * (H.FEATURES + 1)


def test_least_cut_against_all_labellings():
    r = random.Random(1)
    for _ in range(300):
        n = r.randrange(1, 10)
        gains = [r.randrange(-6, 7) for _ in range(n)]
        edges = {(a, b): r.randrange(5) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.4}
        cost = lambda labels: sum(abs(g) for g, x in zip(gains, labels) if x != (g > 0) and g) + sum(w for (a, b), w in edges.items() if labels[a] != labels[b])  # noqa: B023,E731
        every = sorted((cost(x), sum(x), x) for x in itertools.product([False, True], repeat=n))
        assert tuple(H.least_cut(gains, edges)) == every[0][2]


def text_of(page, weights=NONE):
    return H.main_text(page, weights)


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""), ("", ""), (" \n ", ""), ("<article></article>", ""),
        ("<article>a&amp;b &lt;i&gt; &#233;&nbsp;x</article>", "a&b <i> é x"),
        ("<nav>Menu</nav><article><h1>T</h1><p>One\n two<b> three</b>four<p>five<br>six</article><footer>End</footer>", "T One two threefour five six"),
        ("<article><p>x<script>if (a<b) '</p>'</script>y<style>p{}</style></p><!-- <p>no</p> -->z", "xy z"),
        ("<article><p>kept</p><aside>no</aside><div class='ad-box'>no</div><form>no<p>no</p></form><section id=comments><article><p>no</p></article></section><p>last</p></article>", "kept last"),
        ("<header>Site</header><main><header><h1>Title</h1></header><p>Text</p><footer>by me</footer></main>", "Title Text"),
        ("<form id=aspnet><div class=menu>m</div><article><p>Text</p></article><p>no</p></form>", "Text"),
        ("<div class='page no-sidebar'><div id='content'><div class='entry-header'>T</div><p>Text <span class='share'>no</span> more</p></div></div><div class='cookieNotice'>no</div>", "T Text more"),
        ("<article>a < b <3 <p title='x>y'>c</p><p title=\"never closed>d</p></article>", "a < b <3 c d"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a b c 1 2 3"),
        ("<article><p>cut off <b>in a <a hre", "cut off in a"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
        ("<ARTICLE><P>Big</P></ARTICLE><DIV CLASS=AD>no</DIV>", "Big"),
    ],
)
def test_pages(page, expected):
    assert text_of(page) == expected


def brute_text(page):
    """The pages of the test tables mark their article: what is in it, cut at its elements of blocks."""
    body = re.search("(?s)<article>(.*?)</article>", page)[1]
    parts = [markup.unescape(re.sub("<[^>]*>", "", x)) for x in re.split("</?(?:p|h1|br)>", body)]
    return " ".join(y for x in parts if (y := " ".join(z for z in re.split("[ \t-\r]+", x) if z)))


def test_query_against_markers(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op13_html_extraction(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == {i: brute_text(x) for i, x in pages.items()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)


def test_without_markers_the_text_decides(spark):
    """Articles without any telling element are found by their text, learned from pages that have them."""
    weights = H.fit_text_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    prose = [" ".join(f"Word{k} and other words that say a little more than before." for _ in range(6)) for k in range(4)]
    links = "".join(f"<li><a href='/x{k}'>Link{k}</a></li>" for k in range(12))
    page = f"<body><ul>{links}</ul>" + "".join(f"<p>{x}</p>" for x in prose) + "<div>&copy; site</div></body>"
    assert text_of(page, weights) == " ".join(prose)


def test_odd_rows(spark):
    pages = [(1, None), (2, ""), (3, "<article>a</article>"), (3, "<article>a</article>"), (None, "plain text only"), (4, "<<<>>>&&&"), (5, "<p>" * 50_000 + "deep" + "</div>" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumns({c: F.lit("own") for c in ("Text", "n_chars", "_text")})
    out = H.extract_main_text(df)
    assert sorted(map(str, ((r.page_id, r.text) for r in out.collect() if r.page_id in (1, 2, 3)))) == ["(1, '')", "(2, '')", "(3, 'a')", "(3, 'a')"]
    assert sorted(out.columns) == ["_text", "html", "n_chars", "page_id", "text"] and out.count() == len(pages)
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_very_long_pages():
    """Many blocks, deep nesting, unclosed quotation marks and tags: time grows with the page."""
    began = time.time()
    long_ = "<article>" + "".join(f"<p>Paragraph {k} says something.</p>" for k in range(60_000)) + "</article>"
    assert text_of(long_).count("Paragraph") == 60_000
    assert text_of("<article>" + "<div><b>x" * 50_000).count("x") == 50_000
    assert text_of("<article>" + "<a title='x>y" * 50_001).endswith("y")
    assert text_of("".join(f"<p>{'Some prose, it seems. ' * (k % 7)}</p><div><a>{k}</a></div>" for k in range(20_000)), [0.3, -4.0, 1.0, 1.0, 0.0, -1.0, 0.0, 0.0, -1.0])
    assert time.time() - began < 60


def test_measures_read_whole_texts():
    """The share of capitals was that of a text's first 2,000 characters."""
    element = H.Element("p", H.Element("", None, 0), 0)
    for text in ("a" * 3_000 + "B" * 9_000, "B" * 3_000 + "a" * 9_000):
        block = H.Block(element)
        block.text = text
        assert H.measures(block)[4] == sum(map(str.isupper, text)) / 12_000
