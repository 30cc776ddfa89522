import pytest

from chronokg.llm.html_extract import main_text

BODY = "<p>The first part of the text is here.</p><p>And this is the second part of it.</p>"
WANT = "The first part of the text is here.\nAnd this is the second part of it."


@pytest.mark.parametrize("page", [
    f"<body><div class='content has-sidebar'><article>{BODY}</article></div></body>",
    f"<html><head><title>x</title><meta charset=utf-8><body><article>{BODY}</article>",
    f"<html><head><title>x</title><article>{BODY}</article>",
    f"<body><div class='sidebar'><article><p>A teaser that stands aside.</p></article></div><article>{BODY}</article>",
    f"<body><article>{BODY}<div class='comments'><p>What a nice text this is.</p></div></article>",
    f"<body><div class='has-sidebar'><nav><p>The menu of the site</p></nav><article>{BODY}</article></div>",
])
def test_whole_article(page):
    assert main_text(page) == WANT


def test_anchors_and_links_inside_an_article():
    page = f"<article><h2 id='related-work'>Related work</h2>{BODY}<section id='legal-history'><p>It was a law.</p></section><p><a href=x>See the other page</a></p><section id='comments'><p>I like it.</p></section><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></article>"
    assert main_text(page) == f"Related work\n{WANT}\nIt was a law.\nSee the other page"
