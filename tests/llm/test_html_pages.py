"""Pages with everyday class names and without an article element; what the clustering decides."""

import numpy as np
import pytest

from facelake.llm import html_extract
from facelake.llm.html_extract import main_text

P = [f"A long paragraph of the article with many words that tell of its subject at some length, in part {i}. " * 3 for i in range(5)]
P = [p.strip() for p in P]
BODY = "<h1>Head line</h1>" + "".join(f"<p>{p}</p>" for p in P)
WANT = "\n".join(["Head line", *P])
READER = "<div class='c'><p>A reader says that this is a very fine article and has some more to say about it all, at length.</p></div>"
STORIES = "<ul><li><a href=/1>Another story of the day</a><li><a href=/2>One more story</a></ul>"
CASES = {
    "top bar": f'<div class="top-bar"><a href=/>Home</a> <span>Call us today</span></div><div class="post-body">{BODY}</div>',
    "site footer": f'<div class="post-body">{BODY}</div><div class="site-footer"><p>Copyright of the company and others</p><a href=/>Imprint</a></div>',
    "cookies": f'<div class="cookie-banner__inner"><p>We use cookies on this site to make it work and to show adverts.</p></div><div class="content">{BODY}</div>',
    "ad unit": f'<div class="content">{BODY}<div class="ad-unit"><p>Buy the new thing now, it is cheap and good.</p></div></div>',
    "sponsored": f'<div class="content">{BODY}<div class="sponsored-content"><p>{P[0]} buy</p></div></div>',
    "comments beside an article": f'<article>{BODY}</article><section id="user-comments">{READER * 40}</section>',
    "comments longer than the text": f'<div class="story">{BODY}</div><div class="reader-comments">{READER * 60}</div>',
    "share buttons": f'<article><div class="share-buttons-wrapper"><a href=#>Share</a></div>{BODY}</article><div class="top-bar">x</div>',
    "plain divs": f'<div id="hd"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div id="bd"><div id="c1">{BODY}</div><div id="c2">{STORIES}</div></div><div id="ft"><p>Small print</p></div>',
    "linked headline": f'<div id="x"><div>{BODY.replace("Head line", "<a href=/self>Head line</a>")}</div>{STORIES}</div>',
    "layout names": f'<div class="with-sidebar comments-open ad-free">{BODY}</div>',
}


@pytest.mark.parametrize("name", CASES)
def test_everyday_names(name):
    assert main_text(f"<html><body>{CASES[name]}</body></html>") == WANT


def test_a_paragraph_named_like_boilerplate_stays():
    assert main_text(f'<article>{BODY}<p id="related">{P[0]} and more</p></article>') == f"{WANT}\n{P[0]} and more"


def test_two_articles_bring_no_footer():
    text = main_text(f'<article>{BODY}</article><article><p>{P[0]} x</p><p>{P[1]} y</p></article><div class="site-footer">Footer of the site</div>')
    assert text.startswith(WANT) and "Footer" not in text


def test_headline_in_an_element_of_its_own():
    parts = BODY.split("</h1>")
    assert main_text(f"<body><div>{STORIES}</div><div><div>{parts[0]}</h1></div><div>{parts[1]}</div></div><div>{STORIES}</div></body>") == WANT


PLAIN = [  # no names and no article elements: only how much text there is for each tag tells
    f"<div><ul><li><b>Home</b><li><b>News</b><li><b>Sport</b></ul></div><div>{BODY}</div><div><ul><li><i>Small print</i><li><i>Imprint</i><li><i>Contact</i></ul></div>",
    f"<table><tr><td><b>Menu</b><br><b>One</b><br><b>Two</b></td><td>{BODY}</td></tr></table><center><i>All rights</i> <i>reserved</i></center>",
    f"<div><div><span>Today</span> <span>in town</span></div><div><span>Weather</span> <span>fair</span></div><div><span>Wind</span></div></div><div>{BODY}</div>",
]


def test_clustering_decides(monkeypatch):
    pages = [f"<html><body>{x}</body></html>" for x in PLAIN]
    with_it = [main_text(p) for p in pages]
    assert with_it == [WANT] * len(pages)
    monkeypatch.setattr(html_extract, "content_lines", lambda lengths, *_: np.ones(len(lengths), bool))
    assert all(main_text(p) != w for p, w in zip(pages, with_it, strict=True))
