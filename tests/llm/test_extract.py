from __future__ import annotations

import pytest

from casefile.llm.extract import extract, main_text

LONG = "A paragraph of the story, long enough to count, with commas, of course."
BODY = f"<h1>Title &amp; more</h1><p>{LONG}<p>Short <em>wo</em>rd.</p><ul><li>one<li>two</ul><p>{LONG}</p>"
WANT = f"Title & more {LONG} Short word. one two {LONG}"
JUNK = "<p>Junk, junk, junk, and more, all of it, every day, of any kind, really.</p>"

FRAMES = {
    "article": "<nav><a>Home</a></nav><article>{}</article><footer>x</footer>",
    "main": "<header><h1>Site</h1></header><main><div>{}</div></main>",
    "classes": '<div class="top-menu"><a>a</a></div><div id="content">{}</div><div class="sidebar">' + JUNK + "</div>",
    "wrapper named after junk": '<div class="page with-sidebar"><div class="story">{}</div><div class="Comments">' + JUNK * 9 + "</div></div>",
    "form around all": "<form><div><article>{}</article></div><input value='x'></form>",
    "inside": '<article>{}<div class="ad">' + JUNK + "</div><aside>" + JUNK + '</aside><form>a<input></form><section id="comments"><article class="comment">' + JUNK + "</article></section></article>",
    "notice": '<div id="cookie-consent" role="dialog">' + JUNK + '</div><script>var t="</p>";</script><style>p{{}}</style><!-- <p>no</p> --><article>{}</article>',
    "hidden": '<div style="display: none">' + JUNK + "</div><article>{}<p hidden>x</p></article>",
    "cut off": "<nav>a</nav><article>{}",
    "links": "<div>" + "<p><a href='x'>Linked, words, and more, of them, in a list.</a></p>" * 20 + "</div><div>{}</div>",
}


@pytest.mark.parametrize("name", FRAMES)
def test_frames(name):
    assert main_text("<!DOCTYPE html><html><head><title>No</title></head><body>" + FRAMES[name].format(BODY)) == WANT


def test_edges():
    assert main_text(None) == main_text("") == main_text("<p> \n</p>") == main_text("<nav>x</nav>") == ""
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("<p>a<br>b&nbsp; c") == "a b c"
    assert main_text("<p>1 < 2 <b>and</b></p>") == "1 < 2 and"
    assert main_text("<div>" * 30_000 + "deep") == "deep"
    assert len(main_text("<p>a, b</p>" * 50_000)) == 5 * 50_000 - 1
    assert main_text("<article><header><h1>H</h1><p>by me</p></header><p>Body.</p></article>") == "H Body."


@pytest.mark.parametrize(
    "attributes",
    ['data-id="promo"', "data-role='share'", 'title="see id=nav"', "title='class=\"ad\" hidden'", "data-hidden", "my-class=ad", 'data-style="display:none"', "aria-label=hidden", "xclass = sidebar"],
)
def test_names_of_attributes_count_whole(attributes):
    assert main_text(f"<article>{BODY}<div {attributes}>{LONG}</div></article>") == f"{WANT} {LONG}"


@pytest.mark.parametrize("attributes", ["ID=promo", "class = 'x ad'", "data-x=1 ROLE=complementary", "HIDDEN", "hidden=''", 'STYLE="Display : None"', "title='a b' aria-hidden=true"])
def test_parts_by_attributes(attributes):
    assert main_text(f"<article>{BODY}<div {attributes}>{JUNK}</div></article>") == WANT


def test_rows(spark):
    rows = [(1, "u", "<p>é, a</p>", "t"), (1, "u", "<p>é, a</p>", "t"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in extract(frame).collect() if r.page_id) == [(1, "u", "é, a", 4)] * 2
    assert [tuple(r) for r in extract(frame).collect() if not r.page_id] == [(None, None, "", 0)]
    assert extract(frame.filter("false")).count() == 0
