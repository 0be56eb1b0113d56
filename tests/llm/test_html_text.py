"""Main text: what stands between paragraphs, names inside the main part, reader comments, deep pages."""

from __future__ import annotations

import pytest

from foliant.llm.html_text import main_text

LONG = "Long words of the story of the mill and the river, which say a good deal more. " * 5
SHORT = [f"Plain paragraph number {k} of the page, some words." for k in range(6)]


@pytest.mark.parametrize("between", ["<aside>Aside</aside>", "<nav>Menu</nav>", "<nav><a href=/x>Menu of links to read</a></nav>", '<div class="ad">Buy this mill</div>', '<div class="newsletter-signup"><p>Get it by post</p></div>', "<form>Your name</form>"])
@pytest.mark.parametrize("frame", ["{}", "<div>{}</div>", "<article>{}</article>", '<div class="page">{}</div>'])
def test_what_stands_between_paragraphs_does_not_pull(between, frame):
    assert main_text(frame.format("".join(f"<p>{p}</p>{between}" for p in SHORT))).split("\n") == SHORT


def test_thousands_of_paragraphs_with_menus_between():
    assert main_text("".join(f"<p>{SHORT[0]}</p><nav>x</nav>" for _ in range(5_000))).count("\n") == 4_999


@pytest.mark.parametrize("name", ["side-effects", "social-history", "related-work", "widget-basics", "alert", "notice"])
def test_names_of_other_things_inside_the_main_part(name):
    whole = LONG.strip()
    assert main_text(f'<article><p>A side note</p><div class="{name}">{LONG}</div><p>{LONG}</p></article>').split("\n") == ["A side note", whole, whole]
    assert main_text(f'<article><div class="{name}">{LONG}</div></article>') == whole


@pytest.mark.parametrize("rest", [
    '<div class="social"><a href="/s">Share</a> this</div>', '<div class="related"><ul><li><a href="/r">Another story about a mill</a></li></ul></div>', f'<div class="comments"><p>{LONG}</p></div>', f'<ol class="commentlist"><li>{LONG}</li></ol>',
    f'<section class="reader-voices"><h3>3 thoughts on The mill</h3><ol><li>{LONG}</li></ol></section>', f"<section><h2>Comments</h2><div><p>{LONG}</p></div></section>", f"<div><h4>Kommentare (2)</h4><p>{LONG}</p></div>", f"<h3>12 Comments</h3><div><b>Ann</b><p>{LONG}</p></div><p>{LONG}</p>",
    f'<div class="cookie-notice">{LONG}</div>',
])
@pytest.mark.parametrize("place", ["inside", "after"])
def test_what_is_not_the_story_goes(rest, place):
    story = f"<h1>The mill</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
    html = f"<body><article>{story}{rest}</article></body>" if place == "inside" else f"<body><article>{story}</article>{rest}</body>"
    assert main_text(html).split("\n") == ["The mill", *[LONG.strip()] * 3]


def test_a_story_about_comments_stays():
    html = f"<article><h1>How we read</h1><h2>Comments</h2><p>{LONG}</p><h2>Replies</h2><p>{LONG}</p><p>Comments</p></article>"
    assert main_text(html).count(LONG.strip()) == 2


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "words", "<b>" * 100_000 + "words", "<div>words " * 100_000, "<div>" * 100_000 + "<p>words</p>" * 9, "<ul><li>" * 100_000 + "words", "<article>" * 50_000 + "words" + "</article>" * 50_000])
def test_pages_of_any_depth(html):
    assert main_text(html).replace("\n", " ").split() == ["words"] * html.count("words")
