"""Pages whose article is in parts, or within a form or an element with an aside's name."""

import pytest

from detectlab.llm import htmltext

LONG = "".join(f"<p>{f'Part {i}, with words, and more words. ' * 8}</p>" for i in range(10))
SHORT = "<p>A short section, of its own.</p>"


def plain(html):
    import re

    return " ".join(re.sub("<[^>]+>", " ", html).split())


def test_an_article_of_several_sections():
    inner = f"<h1>Title</h1><section>{LONG}</section><h2>Next</h2><section>{SHORT}</section><ul><li>one</li><li>two</li></ul>loose text"
    menu = "<ul><li><a href=1>Other page</a></li><li><a href=2>And one more</a></li></ul>"
    for tag in ("article", "main"):
        page = f"<html><body><div><p>Not this, no.</p></div><{tag}>{inner}{menu}<div class=related><p>no</p></div></{tag}></body></html>"
        assert htmltext.main_text(page) == plain(inner)
    deep = f"<article><h1>T</h1><div><section>{LONG}</section><h2>Next</h2></div><section>{SHORT}</section>{menu}</article>"
    assert htmltext.main_text(deep) == plain(deep.replace(menu, ""))


@pytest.mark.parametrize("wrap", ['<form id="aspnetForm">%s</form>', '<div class="content has-sidebar">%s</div>',
                                  '<form class="page-form"><div class="has-sidebar">%s</div></form>'])
def test_wrapped_pages(wrap):
    inside = f"<h1>Title</h1>{LONG}<form><p>mail, name</p></form><div class=sidebar><p>Other, things.</p></div>"
    page = f"<html><body><nav><p>{'menu, ' * 900}</p></nav>{wrap % inside}<footer><p>(c)</p></footer></body></html>"
    assert htmltext.main_text(page) == plain(f"<h1>Title</h1>{LONG}")


def test_long_comments_stay_out():
    page = f"<html><body><div class=content><h1>T</h1><p>A text, of its own, not long.</p></div><div class=comments>{LONG}</div></body></html>"
    assert htmltext.main_text(page) == "T A text, of its own, not long."


def test_a_long_sidebar_beside_a_short_article_stays_out():
    for page in (f"<body><article><h1>T</h1><p>A text.</p></article><div class=sidebar>{LONG}</div></body>",
                 f"<body><div><h1>T</h1><p>A text.</p></div><div class=sidebar>{LONG}</div></body>"):
        assert htmltext.main_text(page) == "T A text."


def test_class_words_do_not_remove_text():
    kept = ("<p class='notice-period'>The notice period is long.</p><p class='social-science'>Social.</p>"
            "<div class='related-work'><p>Others did.</p></div><p class='search-results'>We found.</p>")
    gone = ("<p class=notice>NO</p><div class='related-posts'><p>no</p></div><div class='ad-slot'><p>no</p></div>"
            "<div class='notice-period'><a href=1>no</a></div><div class='comment-thread'><p>no</p></div>")
    page = f"<html><body><article><h1>T</h1>{LONG}{kept}{gone}</article></body></html>"
    assert htmltext.main_text(page) == plain(f"<h1>T</h1>{LONG}{kept}")


def test_a_named_container_is_kept_whole():
    inner = f"<section>{LONG}</section><h2>Next</h2><section>{SHORT}</section><ul><li>one</li></ul><div><p>Loose.</p></div>"
    menu = "<ul><li><a href=1>Other page</a></li></ul>"
    page = f"<html><body><div class=post>{inner}{menu}</div><div><p>Not this.</p></div></body></html>"
    assert htmltext.main_text(page) == plain(inner)


def test_short_ends_own_titles_and_titles_alone():
    quote = f"<div><blockquote>{'Long quote, with words. ' * 40}</blockquote><p>Short close.</p></div>"
    assert htmltext.main_text(f"<html><body>{quote}</body></html>") == plain(quote)
    page = f"<html><body><header><h1>Site</h1></header><article><header><div><h1>Own</h1></div><p>by me</p></header>{LONG}</article></body></html>"
    assert htmltext.main_text(page) == plain(f"<h1>Own</h1>{LONG}")
    assert htmltext.main_text("<html><body><h1>Only</h1></body></html>") == "Only"
