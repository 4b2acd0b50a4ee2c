"""Whole articles whatever divs they are laid out in."""

import pytest

from facelake.llm.html_extract import main_text

LONG = "A long paragraph of the article with many words that tell of its subject at some length. " * 4
PARTS = ["Headline", "The lead of the article.", LONG.strip(), LONG[::-1].strip(), "The end."]
INNER = "<h1>{}</h1><p>{}</p><div class=body><p>{}</p><p>{}</p></div><section><p>{}</p></section>".format(*PARTS)
NAV = "<nav><a href=/>Home</a></nav>"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_all_of_the_article(tag):
    page = f"<html><body>{NAV}<{tag}>{INNER}</{tag}><footer>Imprint</footer></body></html>"
    assert main_text(page).split("\n") == PARTS


@pytest.mark.parametrize("name", ["page has-sidebar", "no-comments", "content ad-free", "withSidebar"])
def test_layout_names_hide_nothing(name):
    page = f'<html><body>{NAV}<div class="{name}"><article>{INNER}</article></div></body></html>'
    assert main_text(page).split("\n") == PARTS


@pytest.mark.parametrize("name", ["ad", "story sidebar", "ad-banner", "ad-1", "related-posts", "comments-area", "socialShare"])
def test_names_of_boilerplate_hide(name):
    page = f'<html><body><article>{INNER}<div class="{name}"><p>{LONG}</p></div></article></body></html>'
    assert main_text(page).split("\n") == PARTS


def test_no_content_line_is_lost_without_article():
    page = f"<html><body><div><div><p>{LONG * 9}</p></div><div><p>{LONG}</p></div></div></body></html>"
    assert main_text(page).split("\n") == [(LONG * 9).strip(), LONG.strip()]
