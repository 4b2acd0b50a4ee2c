"""Planted articles, exact texts, and pages made to break a parser."""

import random
import time

import pytest

from facelake.llm.html_extract import main_text

PARAGRAPHS = [" ".join(f"w{random.Random(k).randrange(999)}x{i}" for i in range(n)) for k, n in enumerate((60, 45, 3, 70, 52))]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
ALL = "\n".join(PARAGRAPHS)
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News of the day</a></li></ul></nav>"
FOOT = "<footer>Imprint and contact</footer>"


def page(inner):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{inner}</body></html>"


@pytest.mark.parametrize(
    "inner",
    [
        f"{NAV}<article>{BODY}</article>{FOOT}",
        f"{NAV}<main><div><div>{BODY}</div></div></main>{FOOT}",
        f'<div class="layout has-sidebar">{NAV}<div>{BODY}</div>{FOOT}</div>',
        f'<div id="main-no-comments">{NAV}<article>{BODY}</article></div>',
        f'<form id="aspnetForm">{NAV}<div>{BODY}</div>{FOOT}</form>',
        f'<div class="sidebar">{NAV}<article>{BODY}</article>{FOOT}</div>',
        f"<nav><a href=/>Home</a><article>{BODY}</article>{FOOT}",
        f"<nav><a href=/>Home</a><div>{BODY}</div>",
        f'{NAV}<article>{BODY}<div class="comments"><p>{PARAGRAPHS[0]} said a reader</p></div></article>{FOOT}',
        f'<article>{BODY}</article><section id="comments"><article><p>{ALL}</p><p>{ALL}</p></article></section>',
        f'<article>{BODY}</article><section id="comments"><p>{ALL} {ALL} {ALL} {ALL} {ALL} {ALL}</p></section>',
        f'<div class="cookie-notice"><p>{PARAGRAPHS[1]}</p></div><article>{BODY}</article>',
        f'<aside>{PARAGRAPHS[0]}</aside><div class="post">{BODY}</div><div role="complementary">{PARAGRAPHS[0]}</div>',
        f"<div><a href=/>Home</a> <a href=/c>Contact</a></div><div>{BODY}</div>",
        f'<article>{BODY}<span class="ad">buy now</span></article>',
        f"<article>{BODY}<script>var x = '<p>no</p>';</script><!-- no --></article>",
        f"<article>{BODY}</article><!-- no end <p>no</p>",
        f"<article>{BODY}</article><a href='no end",
    ],
)
def test_article(inner):
    assert main_text(page(inner)) == ALL


def test_parts_of_the_article_stay():
    inner = (
        f"<article><header><h1>Headline</h1><p>A standfirst.</p></header>{BODY}<p>Energy is <math><mi>E</mi></math> here.</p>"
        f'<section class="related-work"><p>Other work.</p></section><p class="notice-period">Four weeks.</p></article>'
    )
    assert main_text(page(NAV + inner)) == "\n".join(["Headline", "A standfirst.", *PARAGRAPHS, "Energy is E here.", "Other work.", "Four weeks."])


def test_references_and_space():
    assert main_text(page("<article><p>a&amp;b \n\t c&nbsp;d&#233;</p><p> </p><p>x<br>y</p></article>")) == "a&b c dé\nx y"


@pytest.mark.parametrize("html,text", [("", ""), ("  ", ""), ("plain text & more", "plain text & more"), ("a < b", "a < b"), ("<p>a</p><![foo[ x ]]><p>b</p>", "a\nb"), ("<p>a<", "a<"), ("<p>a</p><!x", "a"), ("<![CDATA[ z ]]><p>a</p>", "a"), ("<script>x", "")])
def test_odd_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "html",
    ["<div>" * 20000 + "</section>" * 20000 + BODY, "<!--" * 50000, "<a " * 50000, "</" * 50000, "<form>" * 20000 + BODY, f"<article><p>{'x' * 10}</p></article>" * 5000, "<li>" * 50000, '<a b="' * 50000, "<p>" + "word " * 200000, "&" * 100000, "<![x" * 30000],
    ids=range(11),
)
def test_time_grows_with_length_only(html):
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 6
