from __future__ import annotations

import time
import tracemalloc

import pytest

from pedalflow.llm.html_extraction import extracted, main_text

PROSE = "Long text of an article, with commas, full stops. It goes on for a while, as articles do."


def page(body):
    return f"<!DOCTYPE html><html><head><title>Title, of a page.</title><style>p{{a:b}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        "<nav><ul><li><a href='/'>Home page, of all.</a></li></ul></nav><article>{}</article><footer>Foot, of the page.</footer>",
        "<header><p>Head, of a page, with much text in it, and more.</p></header><main>{}</main>",
        "<div class='menu'><a href=x>One</a> <a href=y>Two</a></div><div id='content'>{}</div><div class='side-bar sidebar'><p>Side, with a long text, of its own. And more of it, too.</p></div>",
        "<article>{}<form><label>Your name, please.</label><input></form></article><section id='comments'><p>I read this, and I liked it, very much. Thanks, all.</p></section>",
        "<div class='cookie-notice'>We use cookies, as you know. Accept, or leave.</div>{}<aside>Related, things.</aside>",
        "<div class='wrap'><div class='ad'>Buy this, now. It is good, cheap, and new.</div>{}</div><script>var t = '<p>no, not this.</p>';</script>",
        "<div><ul><li><a href=1>First of the links</a><li><a href=2>Second of the links</a></ul></div><article>{}</article>",
    ],
)
def test_only_the_article_is_kept(body):
    text = f"<h1>Heading</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p>"
    assert main_text(page(body.format(text))) == f"Heading\n{PROSE}\nShort one.\n{PROSE}"


def test_linked_blocks_of_an_article_stay_and_lists_of_links_go():
    body = (
        f"<article><h1><a href='/t'>The title</a></h1><p>{PROSE}</p><h2><a href='#a'>Part one</a></h2><p>{PROSE}</p><p><a href='x'>A paper</a></p><p>{PROSE}</p>"
        f"<p>See <a href='x'>a long name of a page</a> and <a href='y'>another name</a>.</p><ul><li>{PROSE}</li><li><a href='x'>One linked item</a></li><li>{PROSE}</li></ul>"
        "<ul><li><a href='1'>More one</a></li><li><a href='2'>More two</a></li></ul><div><a href='1'>Next</a> | <a href='2'>Last</a></div></article>"
    )
    lines = ["The title", PROSE, "Part one", PROSE, "A paper", PROSE, "See a long name of a page and another name.", PROSE, "One linked item", PROSE]
    assert main_text(page(body)) == "\n".join(lines)


def test_names_that_come_from_the_text_mark_nothing():
    body = (
        f"<article><div class='post-header'><h1 id='search'>Title</h1></div><p>{PROSE}</p><h2 id='related-work'>Related</h2><p id='copyright-law'>{PROSE}</p>"
        f"<section id='discussion'><h2 id='search-algorithms'>Search</h2><p>{PROSE}</p></section><section id='disclaimer'><p>{PROSE}</p></section>"
        f"<section id='sharing-of-comments'><p class='notice'>{PROSE}</p></section><div class='header'><h2 id='social-impact'>Impact</h2></div><p>{PROSE}</p></article>"
    )
    lines = ["Title", PROSE, "Related", PROSE, "Search", PROSE, PROSE, PROSE, "Impact", PROSE]
    around = "<div class='header'><p>Head, of a site, and more.</p></div>{}<div class='related'><p>Other, things, to read.</p></div><section id='comments'><p>Nice, text, all.</p></section>"
    assert main_text(page(body)) == "\n".join(lines)
    assert main_text(page(around.format(body))) == "\n".join(lines)
    open_page = f"<div><h1 id='meta-analysis'>Title</h1><section id='discussion'><p>{PROSE}</p></section><section id='search-costs'><p>{PROSE}</p></section></div>"
    assert main_text(page(open_page)) == f"Title\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize(
    "wrapper",
    [
        "div class='layout-sidebar'", "div class='content-with-sidebar'", "div class='wrapper sidebar-right'", "div class='banner-on'", "div class='post-with-comments'",
        "div class='login-enabled'", "form id='aspnetForm'", "form><div class='layout-sidebar'",
    ],
)
def test_a_marked_wrapper_does_not_lose_the_article(wrapper):
    end = f"</{wrapper.split()[0].split('>')[0]}>"
    around = "<nav><a href='/'>Home page, of all.</a></nav>{}<div class='sidebar'><article><p>A teaser, of something.</p></article></div><div id='comments'><p>Nice, text, all.</p></div>"
    for body in (f"<article><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></article>", f"<div id='content'><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div>"):
        assert main_text(page(f"<{wrapper}>{around.format(body)}{end}")) == f"Title\n{PROSE}\n{PROSE}"


def test_comments_longer_than_the_article_stay_out():
    body = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p><div id='comments'>" + "".join(f"<article class='comment'><p>{PROSE} Number {i}, of many.</p></article>" for i in range(9)) + "</div>"
    assert main_text(page(f"<div>{body}</div>")) == f"Title\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize("hostile", ["<div>word, one." * 20_000, "<![CDATA[ x" * 100_000, "<div><p>a, b." * 20_000 + "</section>" * 20_000, "<b>" * 50_000 + PROSE])
def test_hostile_pages_take_linear_time(hostile):
    tracemalloc.start()
    began = time.process_time()
    main_text(hostile)
    took, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 30 and peak < 200e6  # tracing slows it several times


def test_references_white_space_and_inline_elements():
    text = f"<p>  A &amp; B&nbsp;&#233;&lt;x&gt;\n <b>bold</b><i>er</i>, text.<br>Next<!-- no --> line </p><p>{PROSE}</p>"
    assert main_text(page(f"<article>{text}</article>")) == f"A & B é<x> bolder, text. Next line\n{PROSE}"


def test_broken_nesting_and_a_page_that_ends_early():
    text = f"<article><p>{PROSE}<p><b>Second, unclosed.<p>Third, one <i>here</b>.<ul><li>Item, one.<li>Item, two."
    assert main_text(f"<html><body>{text}") == f"{PROSE}\nSecond, unclosed.\nThird, one here.\nItem, one.\nItem, two."
    assert main_text(f"<body><p>{PROSE}</p><p>And, then <a href='x") == f"{PROSE}\nAnd, then"


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<nav>Only a menu, here.</nav>", "<p", "</p></div>", "<script>let a = 1;"])
def test_nothing_to_extract(html):
    assert main_text(html) == ""


def test_plain_text_and_very_long_pages():
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text(page("<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>")).count("\n") == 4999
    assert main_text("<div>" * 20_000 + PROSE) == PROSE


def test_table(spark):
    rows = [(1, "u", page(f"<p>{PROSE}</p>"), "a"), (1, "u", page(f"<p>{PROSE}</p>"), "a"), (None, None, None, None)]
    out = extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "u", PROSE, len(PROSE))] * 2 + [(None, None, "", 0)], key=str)
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
