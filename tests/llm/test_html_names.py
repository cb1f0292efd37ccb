"""Names and unclosed elements take no text of the article."""

import time

import pytest

from folioflow.llm.html_extract import Page, main_text

TEXT = "First, long enough, sentence of the article, with commas, to be counted."


@pytest.mark.parametrize(
    "source,want",
    [
        (f"<body><div class='content has-sidebar'><div><p>{TEXT}</p><p>{TEXT} Two.</p></div></div></body>", [TEXT, f"{TEXT} Two."]),
        (f"<div class='no-sidebar'><article><p>{TEXT}</p></article></div>", [TEXT]),
        (f"<article><h2 id='social-impact'>Impact</h2><section id='related-work'><p>{TEXT}</p></section><p id='search-methods'>Methods</p></article>", ["Impact", TEXT, "Methods"]),
        (f"<article><p>Before <svg viewBox='0 0 1 1'/> after</p><p>{TEXT}</p></article>", ["Before after", TEXT]),
        (f"<article><p>Unclosed <select><option>x</p><p>{TEXT}</p><canvas></article>", ["Unclosed", TEXT]),
        (f"<article><p>Sum <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here</p><p>{TEXT}</p></article>", ["Sum x=1 here", TEXT]),
        (f"<article><iframe src=x /><p>{TEXT}</p></article>", [TEXT]),
        (f"<body><div class=post><p>{TEXT}</p><p>{TEXT}</p></div><div class=sidebar><p>{TEXT} Side</p></div><script>var a;", [TEXT, TEXT]),
    ],
)
def test_article_is_whole(source, want):
    assert main_text(source).split("\n") == want


def test_links_and_objects():
    page = Page("<ul><li><a href=x><b><i><u><span><em>linked words here</em></span></u></i></b></a> plain</li></ul>")
    assert [(text, link) for _, text, link in page.blocks] == [("linked words here plain", 17)]
    shown = main_text("<article><p>One, two, three, and <object>text of an object</object> <canvas>and of a canvas</canvas> end.</p></article>")
    assert shown == "One, two, three, and text of an object and of a canvas end."


@pytest.mark.parametrize(
    "source,want",
    [
        (f"<article><p>{TEXT}</p><div class='ad'><p>Buy this now.</p></div><div class='share'>Share</div><p>{TEXT} Two.</p><section class='comments'><p>First!</p></section></article>", [TEXT, f"{TEXT} Two."]),
        (f"<main><div class='post social'><p>{TEXT}</p><p>{TEXT}</p></div><p>End.</p></main>", [TEXT, TEXT, "End."]),
        (f"<article class='promo'><p>{TEXT}</p></article>", [TEXT]),
        (f"<article><script src=x />var code = 1;</script><p>{TEXT}</p></article>", [TEXT]),
        (f"<article><script src=x /><p>{TEXT}</p></article>", [TEXT]),
        (f"<article></section></i></p><p>{TEXT}<noscript></article>", [TEXT]),
    ],
)
def test_what_is_foreign_to_an_article(source, want):
    assert main_text(source).split("\n") == want


@pytest.mark.parametrize("start", ["<div>", "<div class=a>", "<article>", "<b>", "<li>", "<noscript>", "<div></section>", "<ul><li>", "<table><tr><td>"])
def test_time_grows_with_length(start):
    n = 300_000 // len(start)
    begun = time.process_time()
    assert main_text(start * n + f"<p>{TEXT}</p>").endswith(TEXT)
    assert time.process_time() - begun < 20
