"""Pages whose article lies in marked elements, is marked itself, or is written as several articles."""

import pytest

from scoreframe.llm import html_extract

NAV = "<nav><a href='/'>Home</a></nav>"


def prose(name, n=5):
    return "".join(f"<p>{name} {i}, with enough words, commas, and sense to count as prose.</p>" for i in range(n))


def lines(name, n=5):
    return [f"{name} {i}, with enough words, commas, and sense to count as prose." for i in range(n)]


def read(body, attributes=""):
    return html_extract.extract(f"<html><body {attributes}>{NAV}{body}<footer>Imprint</footer></body></html>").split("\n")


@pytest.mark.parametrize("mark", ["class='page has-sidebar'", "class='content-sidebar-wrap'", "class='with-comments'", "class='side-by-side'", "id='no-header'"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_marked_wrapper_of_the_article_stays(mark, tag):
    assert read(f"<div {mark}><{tag}>{prose('A')}</{tag}></div>") == lines("A")
    assert read(f"<div {mark}><{tag}>{prose('A')}</{tag}><div class='sidebar'>{prose('S', 2)}</div></div><div><p>Teaser, short.</p></div>")[:5] == lines("A")
    assert not any(x.startswith("S ") for x in read(f"<div {mark}><{tag}>{prose('A')}</{tag}><div class='sidebar'>{prose('S', 2)}</div></div>"))


def test_marked_parts_are_cut():
    assert read(f"<article>{prose('A')}</article><div id='comments'>{prose('C', 3)}</div>") == lines("A")
    assert read(f"<div><article>{prose('A')}</article><article class='comment'>{prose('C', 2)}</article></div>") == lines("A")
    assert read(f"<div><p>Short, real, text.</p>{prose('A', 4)}</div><article class='comment'>{prose('C', 2)}</article>") == ["Short, real, text.", *lines("A", 4)]
    assert read(f"<article>{prose('A')}</article><div class='related'><article>{prose('R', 1)}</article></div>") == lines("A")


def test_comment_articles_inside_a_long_thread_are_cut():
    thread = "".join(f"<article class='comment'>{prose('C', 2)}</article>" for _ in range(6))
    assert read(f"<article>{prose('A')}</article><div id='comments'>{thread}</div>") == lines("A")


def test_marked_article_that_is_the_page_stays():
    assert read(f"<article class='post has-sidebar'>{prose('A')}</article>") == lines("A")
    assert read("".join(f"<article class='post share'>{prose(a, 3)}</article>" for a in "ABC")) == [x for a in "ABC" for x in lines(a, 3)]


def test_sibling_articles_stay():
    assert read(f"<div><article>{prose('A')}</article><article>{prose('B', 2)}</article></div>") == [*lines("A"), *lines("B", 2)]
    assert read(f"<main><article>{prose('A', 9)}</article><article>{prose('B', 3)}</article><article><p>Teaser</p></article></main>") == [*lines("A", 9), *lines("B", 3)]


def test_sections_named_for_content_stay():
    long = "The text of this section goes on for a while, with commas, clauses, and enough words to count as a paragraph of its own."
    names = ("related-work", "social-history", "share-capital", "footer-structures", "comments-on-method")
    sections = "".join(f"<section class='{n}'><h2>{n}</h2><p>{long} {n}</p></section>" for n in names)
    boxes = "".join(f"<div class='{n}'><p>{long} BOX</p></div>" for n in ("related-posts", "comment-list", "ad-slot", "social-links", "comments", "sidebar-widget-area", "newsletter-signup"))
    text = html_extract.extract(f"<html><body><article><p>{long}</p>{sections}{boxes}<p>{long} end</p></article></body></html>")
    assert all(f"{long} {n}" in text for n in names) and "BOX" not in text and text.endswith("end")
