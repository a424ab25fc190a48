import html
import re
import time

import pytest

from tidemark.llm.html_text import blocks, extract, main_text

LONG = "The committee met on Tuesday to talk about the harbour wall, which has been cracked since the storm of last winter, and agreed to have it mended."
MORE = "Work is to begin in spring and will take about five months, the mayor said, provided that the weather and the budget hold until the end of it."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>Wall</h1><p>{LONG}</p><p>{MORE}</p></article><footer>&copy; 2024</footer></body></html>", f"Wall\n{LONG}\n{MORE}"),
        ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;x<br>y\n\t z<p>second", "a & b <c> é x y z\nsecond"),
        (f"<div class='sidebar'><p>{LONG}</p></div><article><p>{MORE}</p></article>", MORE),
        (f"<article><p>{LONG}</p><div class='ad'>Buy now</div><aside>See also</aside><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
        (f"<article><p>{LONG}</p></article><section id='comments'><p>{MORE}</p></section>", LONG),
        (f"<main><header><h1>Wall</h1></header><p>{LONG}</p><form><p>Your mail</p></form></main>", f"Wall\n{LONG}"),
        (f"<header><p>{MORE}</p></header><div class=content><p>{LONG}</p></div><div class='cookie-notice'>We use cookies</div>", LONG),
        (f"<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul><p>{LONG}</p><p>{MORE}</p>", f"{LONG}\n{MORE}"),
        (f"<article><!-- hidden --><p>{LONG}</p><!-- never closed <p>x</p>", LONG),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_blocks_have_their_link_share():
    found = blocks("<p>one <a href=x>two three</a> four</p><p><a>all</a></p>")
    assert [(b[0], round(b[1], 2)) for b in found] == [("one two three four", 0.5), ("all", 1.0)]


def test_a_very_long_page_is_whole():
    page = "<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(5000)) + "</article>"
    assert main_text(page).count("\n") == 4999
    assert main_text("<article><p>" + "<" * 20000 + "</p></article>") != ""
    assert len(main_text("<article>" + "<div>" * 3000 + "deep words here" + "</div>" * 3000)) == 15


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (1, "u", f"<article><p>{LONG}</p></article>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", [lambda n: "<div>" * n + "</p></i>" * n, lambda n: "<button>x" * n, lambda n: '<a "> "' * n, lambda n: "<i>" * n + "<h1>x</h1>" * n, lambda n: "<a '\">x" * n, lambda n: "<ul><li><p>" * n])
def test_hostile_pages_take_linear_time(page):
    def seconds(n):
        start = time.process_time()
        blocks(page(n))
        return time.process_time() - start

    seconds(500)
    assert seconds(32000) < 16 * max(0.02, seconds(8000))


def test_quotes_in_tags():
    assert [b[0] for b in blocks("<p title='a > b'>x</p><p title=\"y>z</p>")] == ["x", "z"]


def test_like_brute_force_over_pages(spark, data):
    """The given pages have one article each, of paragraphs and a heading."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got)
    for r in rows:
        (article,) = re.findall(r"<article>(.*?)</article>", r["html"], re.S)
        parts = [" ".join(html.unescape(re.sub(r"</?(?:b|i|em|strong|a|span|u)\b[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|pre|table|tr|td)\b[^>]*>", article)]
        text = "\n".join(x for x in parts if x)
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], text, len(text))
