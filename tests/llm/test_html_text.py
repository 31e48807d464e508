import time

import pytest

from logvigil.llm.html_text import extract_text, main_text

LONG = "A sentence of some length, with a comma, and one more, that goes on for a while."

PAGES = {
    "article among the usual parts": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy</div>"
        f"<article><h1>Head</h1><p>{LONG}<p><b>Bold.<br><p>Last &amp; least&nbsp;one.</article><footer>&copy; me</footer>",
        f"Head\n\n{LONG}\n\nBold.\n\nLast & least one.",
    ),
    "content in divs": (
        f"<body><div id=menu><a href=a>Home</a> <a href=b>News</a></div><h1>Head</h1><div class=content><p>{LONG}</p><p>Short.</p></div>"
        f"<div class='side-bar sidebar'><p>{LONG}</p></div><div id=footer class=footer>Foot</div>",
        f"Head\n\n{LONG}\n\nShort.",
    ),
    "unlabelled menu": (
        f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><div><p>{LONG}</p></div>", LONG,
    ),
    "comments of readers": (
        f"<main><p>{LONG}</p><section id='comments'><article class='comment'><p>{LONG} {LONG} {LONG}</p></article></section></main>", LONG,
    ),
    "header, form, notice and script inside the article": (
        f"<article><header><h1>Head</h1><span>by me</span></header><form><p>Sign here</p></form><div class='cookie-notice'>We use</div>"
        f"<p>{LONG}<script>var x = '</p><p>no'</script></p><aside>Aside</aside></article>",
        f"Head\n\n{LONG}",
    ),
    "short parts of a long article stay": (
        f"<article><section><p>Short.</p></section><section><p>{LONG} {LONG}</p></section><ul><li>One<li>Two</ul></article>",
        f"Short.\n\n{LONG} {LONG}\n\nOne\n\nTwo",
    ),
    "page inside a form": (f"<form id=all><div><article><p>{LONG}</p></article></div></form>", LONG),
    "class of the body": (f"<body class='no-sidebar menu'><p>{LONG}</p></body>", LONG),
    "table": ("<table><tr><td>one<td>two<tr><td>three</table>", "one\n\ntwo\n\nthree"),
    "inline elements do not part words": ("<p>wo<b>r</b>d <i>x</i><sup>2</sup>\n\t y</p>", "word x2 y"),
    "broken nesting": ("<b><div>one</b> two</div> three</p></div>", "one two\n\nthree"),
    "quoted sign": ("<p title='a > b'>text</p><p title=\"x>y\">more</p>", "text\n\nmore"),
    "references": ("<p>&lt;p&gt; &eacute; &#233; &#x20ac; &unknown; &amp;amp;</p>", "<p> é é € &unknown; &amp;"),
    "comment and declaration": ("<!DOCTYPE html><!-- <p>no</p> --><?x y?><p>yes<!----> it is</p>", "yes it is"),
    "plain text": ("only  text\n here", "only text here"),
    "cut page": ("<p>begin</p><p>middle <a href='x", "begin\n\nmiddle"),
    "only a menu": ("<nav><a href=x>a</a></nav><footer>b</footer>", ""),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, text = PAGES[name]
    assert main_text(html) == text


def test_nothing_is_shortened():
    words = " ".join(f"w{n}" for n in range(300_000))
    assert main_text(f"<nav>x</nav><article><p>{words}</p></article>") == words


@pytest.mark.parametrize("part", ["<div>", "<b>", "<ul><li>", "<a href='x", "<!--", "<p>x", "<table><tr><td>", "&", '="', "<b><div>", "<x "])
def test_hostile_pages_take_linear_time(part):
    start = time.perf_counter()
    main_text(part * 30_000 + "<p>x")
    assert time.perf_counter() - start < 20


def test_table_of_pages(spark):
    html, text = PAGES["content in divs"]
    rows = [(1, "u", html, 9), (1, "u", html, 9), (None, None, html, 9), (2, "v", None, 9), (3, "w", "", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int").repartition(2)
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    whole, none = (text, len(text)), ("", 0)
    want = [(1, "u", *whole), (1, "u", *whole), (None, None, *whole), (2, "v", *none), (3, "w", *none)]
    order = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert extract_text(pages.where("false")).count() == 0


def test_tables_of_the_workload(spark):
    """Every given page holds one article of a heading and paragraphs; a pattern reads them off."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for row in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)[1]
        blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1)>", "\0", inside.replace("<br>", " "))).split("\0")
        assert got[row.page_id] == "\n\n".join(filter(None, (" ".join(unescape(b).split()) for b in blocks)))
