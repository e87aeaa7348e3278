"""Main text of pages: the given pages against their articles, and layouts with known articles."""

import html
import re
import time

import pytest

from beamframe.llm import queries
from beamframe.llm.tag_path_extract import content_paths, extract_pages, main_text

A = "It was a long day, and nobody knew why; the river, which had risen, fell again."
B = "She said: no. Then, after a while, she said yes, and they left; the door stayed open."
C = "Short one."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><footer>About us.</footer>",
        # no article: names, a sidebar, comments that are longer than the text
        f"<div id=page><div class='site-header'><h2>My site, my home</h2></div><div id=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>"
        f"<div class=post><h1>Title</h1><p>{A}<p>{B}<p>{C}</div><div class=sidebar><p>{A}</p></div><div id='comments'>{f'<div class=c><p>{B} {A}</p></div>' * 9}</div></div>",
        # a wrapper that is named like a menu, a form around all, a header with the title in the article
        f"<form id=f><div class='layout has-sidebar'><div class='sidebar-left-layout'><main><header><h1>Title</h1></header><p>{A}</p><p>{B}</p><p>{C}</p>"
        f"<form><label>Mail, please.</label><input name=q><button>Send it.</button></form></main></div></div></form>",
        # other tags' case, quotes with tags inside, comments, scripts, styles
        f'<!doctype html><HTML><HEAD><TITLE>t</TITLE><STYLE>p>a{{}}</STYLE></HEAD><BODY CLASS="nav-open"><!-- <p>{A}</p> --><SCRIPT>if (a<b) document.write("<p>{A}</p>")</SCRIPT>'
        f"<MAIN DATA-X='<p>no</p>'><H1 title=\"a > b\">Title</H1><P>{A}</P><P>{B}</P><P>{C}</P></MAIN><ASIDE>{A}</ASIDE></BODY></HTML>",
        # words of subjects among an article's classes; notices, adverts, hidden and shared parts
        f"<div class='cookie-banner'><p>{A}</p></div><div role=alert>{B}</div><article class='post category-social tag-ads'><h1>Title</h1><div class='ad-slot'>Buy, buy, buy.</div>"
        f"<p>{A}</p><div hidden><p>{B}</p></div><div style='display: none'>{B}</div><p>{B}</p><ul class=share-buttons><li>Share.</li></ul><p>{C}</p>"
        f"<article class='comment depth-2'><p>{A}</p></article></article>",
        # names in parts, an advert between paragraphs, a link to skip to, a notice inside
        f"<a class='skip-link' href='#m'>Skip to the text.</a><div id='m'><h1>Title</h1><p>{A}</p><div class='side-bar'><p>{B}</p></div><ins class='adsbygoogle'>Buy this, now.</ins><div class='top-banner'>Sale, today only!</div><p>{B}</p><p>{C}</p><div class='pop-up'><p>{A}</p></div><p class='disclaimer'>{A}</p></div>",
        # a table as layout, links without a list, nothing closed
        f"<table><tr><td><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a><td><h1>Title</h1><p>{A}<p>{B}<p>{C}</table>",
    ],
)
def test_layouts(page):
    assert main_text(page) == f"Title\n{A}\n{B}\n{C}"


def test_parts_of_articles_stay():
    page = f"<article><h1>T</h1><p>{A}</p><h2>Why</h2><ul><li>one<li>two <b>bold</b>ly</ul><blockquote>Quote</blockquote><pre>a\n  b</pre><table><tr><td>x<td>y</table><figure><figcaption>Fig. 1</figcaption></figure><p><a href=x>link only</a></p><p>{B}</p></article>"
    assert main_text(page) == f"T\n{A}\nWhy\none\ntwo boldly\nQuote\na b\nx\ny\nFig. 1\nlink only\n{B}"


def test_references_and_white_space():
    page = "<main><p>a&amp;b &lt;i&gt; &copy &#233;&#xe9; &amp;amp; &nosuch; &a\n\t x&nbsp;y<br>z  </p><p> &nbsp; </p><p>R&amp</p></main>"
    assert main_text(page) == "a&b <i> © éé &amp; &nosuch; &a x y z\nR&"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("no tags at all, it is text.", "no tags at all, it is text."),
        ("<nav>Only a menu.</nav>", ""),
        ("<article></article>", ""),
        ("<p>a < b, and c <3 d.", "a < b, and c <3 d."),
        ("<p>text.<p class='open", "text."),
        ("<p>text.<!-- open", "text."),
        ("<p>text.<script>open", "text."),
        ("</div></p></b><p>text.</b></div>", "text."),
        ("<p><b>One, two.<br><p>Three, four.</b> five.", "One, two.\nThree, four. five."),
        ("<article><p>" + "long, " * 200_000 + "</p></article>", ("long, " * 200_000).strip()),
    ],
)
def test_defined_cases(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<div>", "</b>", "<b", "<p>x", "<a href='", '<i x="', "<!--", "<li><b>", "<", "&amp", "<svg/>", "<table><td>"])
def test_time_grows_with_the_page(part):
    began = time.perf_counter()
    main_text("<p>text.</p>" + part * 60_000)
    assert time.perf_counter() - began < 10


def test_paths_by_ratio():
    blocks = [(1, 5, 0), (1, 6, 0), (2, 80, 2), (2, 90, 3), (2, 10, 1), (2, 120, 4), (3, 12, 0)]
    assert content_paths(blocks) == {1: False, 2: True, 3: False}


def _article(page):
    """The generated pages close their articles, but not all that is inside."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(filter(None, (" ".join(p.split()) for p in parts)))


def test_given_pages(spark, small):
    got = {r.page_id: r for r in queries.queries()["op12_tag_path_extract"](spark, small).collect()}
    pages = queries.table(spark, small, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (_article(p.html), len(_article(p.html)), p.url)


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(None, None, None, 1, "t"), (1, "u", "<p>a.", 2, "t"), (1, "u", "<p>a.", 2, "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    assert sorted(map(tuple, extract_pages(df).collect()), key=str) == sorted([(None, None, "", 0), (1, "u", "a.", 2), (1, "u", "a.", 2)], key=str)
    assert extract_pages(df.limit(0)).collect() == []
