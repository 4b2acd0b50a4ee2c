"""Main text of web pages from streamed parser events and smoothed text-to-tag ratios.

The standard library's parser reports tags and text one after the other; block tags end a line.
Each line keeps its text, the tags that fell into it, how much of it is link text, and the element that
holds it. The ratios of text to tags, smoothed by a Gaussian so that short lines among long ones are
carried along, are parted into two clusters, content and the rest, at the threshold halfway between the
clusters' means. Content lines say where the article is:

* Elements that by tag, role, name or style look like navigation, notices, adverts, forms, comments and the
  like are suspects. A suspect goes, unless nearly all content is in it and no main or article element with
  content is outside: then it only wraps the page, whatever it is called.
* The region is the outermost main or article element with nearly all of the content that is left, or on a
  page without one the innermost element that holds all of it, and the headline beside that. All of its lines are the result, so that a
  heading, a lead or a short paragraph stays; where no main or article names the region, lines that are nothing but
  links go, headings aside.

Defined results: null, empty and text-free pages give the empty string; a page without any markup
gives its text; unclosed and stray tags end where the next structural tag says; a comment without an end
and a tag without one reach to the end of the page; should the parser refuse a page, what it had read until
then counts; time grows with the page's length only; repeated rows stay repeated; an empty table gives an
empty result. A column of the input that is called main_text gives way to the new one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facelake.llm.common import text_column

# Element names of the HTML standard by what they do to the text.
INVISIBLE = frozenset("script style noscript template iframe object svg canvas audio video select option datalist textarea button title".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset header".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGION = frozenset("html body main article section div td center blockquote".split())
#: Start tags that an open element of the same kind ends.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
ARTICLE = frozenset("main article".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PROSE = frozenset(("p", "blockquote", "figure", *HEADINGS))
#: Parts of class and id names that mark what is not the article, whatever else the name says.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsors sponsored promo promos cookie cookies consent gdpr popup modal "
    "newsletter subscribe subscription signup login share sharing social sidebar comment comments commentlist commenter disqus reply replies respond "
    "breadcrumb breadcrumbs navbar navigation pagination pager footer masthead topbar copyright disclaimer outbrain taboola".split()
)
#: Parts that mark it only in names that say nothing else.
WEAK = frozenset("promotion notice notices notification overlay aside related recommended recommendations menu nav toolbar widget skip alert toc teaser".split())
#: Pairs of parts that count as one of the strong ones.
PAIRS = frozenset({("top", "bar"), ("nav", "bar"), ("side", "bar"), ("user", "bar"), ("site", "header"), ("page", "header"), ("site", "nav"), ("main", "nav"), ("main", "menu")})
#: Words that may go with weak parts.
NEUTRAL = frozenset("area box item items links list posts section slot".split())
#: Words that turn a name into one of a page's layout, as in has-sidebar or ad-free.
LAYOUT = frozenset("no non not has have with without free open closed enabled disabled layout".split())
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Reach and width of the smoothing, in lines.
REACH, SIGMA = 2, 1.0
#: What a line of another element counts in it.
APART = 0.1
#: An article's element, or one that wraps the page, holds so much of the content lines' text.
SHARE = 0.8
#: One that is named by what is not the article wraps a page only if it holds this much.
NAMED_SHARE = 0.98
#: Characters for each tag from which a line is running text beside whatever other lines.
TEXT = 100
#: A line of links has so much of its text in them.
LINKS = 0.8


#: How much an element's attributes speak against its being part of the article.
CLEAR, NAMED, HINTED = 0, 1, 2


def _suspect(attrs: list[tuple[str, str | None]]) -> int:
    """CLEAR, or HINTED by a weak name, or NAMED by anything stronger."""
    found = CLEAR
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return NAMED
        if key == "role" and (value or "").lower() in ROLES:
            return NAMED
        if key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return NAMED
        if key in ("class", "id") and value:
            for name in value.split():
                listed = [part.lower() for part in _NAME_PARTS.findall(name)]
                parts = set(listed)
                if parts & LAYOUT:
                    continue
                if parts & STRONG or any(pair in PAIRS for pair in zip(listed, listed[1:], strict=False)):
                    return NAMED
                if parts & WEAK and parts <= WEAK | NEUTRAL:
                    found = HINTED
    return found


class Lines(HTMLParser):
    """The lines of a page: texts, tags and link text in each, and the element each belongs to."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag, element
        self.open: Counter[str] = Counter()
        self.invisible = 0
        self.parents: list[int] = [-1]
        self.suspects: list[int] = []
        self.articles: list[int] = []  # elements that are a main or article
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.elements: list[int] = []
        self.heads: list[bool] = []  # whether a heading
        self.named: set[int] = set()  # suspects by more than a weak name
        self.parts: list[str] = []
        self.n_tags = self.n_linked = self.links = 0

    # a declaration is a comment, and what has no end reaches to the end of the page
    def parse_html_declaration(self, i):
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.parse_bogus_comment(i)

    def parse_comment(self, i, report=1):
        end = self.rawdata.find("-->", i + 2)
        return len(self.rawdata) if end < 0 else end + 3

    def _end_line(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.texts.append(text)
                self.tags.append(self.n_tags)
                self.linked.append(self.n_linked)
                self.elements.append(self.stack[-1][1] if self.stack else 0)
                self.heads.append(any(self.open[h] for h in HEADINGS))
                self.n_tags = self.n_linked = 0
            self.parts = []

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.invisible -= tag in INVISIBLE

    def handle_starttag(self, tag, attrs):
        self.n_tags += 1
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            elif tag == "br":
                self.parts.append(" ")
            return
        block = tag in BLOCK
        self.links += tag == "a"
        level = _suspect(attrs) if attrs else CLEAR
        if level == HINTED and tag in PROSE:
            level = CLEAR  # a paragraph's name is not what it is about
        suspect = level != CLEAR
        if block:
            self._end_line()
        elif tag not in INVISIBLE and not suspect:
            return  # phrasing markup holds no lines of its own
        if tag in ("article", "main") and not self.open["article"]:
            # what was left open before the article does not reach into it
            while self.stack and self.stack[-1][0] in BOILERPLATE - {"form"}:
                self._pop()
        ends = SELF_ENDING.get(tag, ())
        while self.stack and (self.stack[-1][0] in ends or (block and self.stack[-1][0] == "p")):
            self._pop()
        own = self.stack[-1][1] if self.stack else 0
        if tag in BOILERPLATE and not (tag == "header" and (self.open["article"] or self.open["main"])):
            suspect, level = True, HINTED  # pages are laid out in these as well
        if tag in REGION or suspect:
            if not block:
                self._end_line()
            self.parents.append(own)
            own = len(self.parents) - 1
            if suspect:
                self.suspects.append(own)
                if level == NAMED:
                    self.named.add(own)
            if tag in ARTICLE:
                self.articles.append(own)
        self.stack.append((tag, own))
        self.open[tag] += 1
        self.invisible += tag in INVISIBLE

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.n_tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCK:
            self._end_line()
        if self.open[tag]:
            if tag not in BLOCK and tag not in INVISIBLE:
                self._end_line()
            ended = False
            while not ended:
                ended = self.stack[-1][0] == tag
                self._pop()

    def handle_data(self, data):
        if not self.invisible:
            self.parts.append(data)
            if self.links:
                self.n_linked += len(data.strip())

    def close(self):
        super().close()
        self._end_line()


def content_lines(lengths: np.ndarray, tags: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Which lines are content: smoothed text-to-tag ratios in the upper of two clusters of their logarithms, parted
    halfway between the clusters' means, or at TEXT where the clusters lie above it. Lines of other elements count for
    APART of their weight, so that what stands right before or behind the article is not carried along."""
    ratio, n = lengths / np.maximum(tags, 1), len(lengths)
    total, weight = ratio.copy(), np.ones(n)
    for shift in range(1, min(REACH, n - 1) + 1):
        w = np.exp(-0.5 * (shift / SIGMA) ** 2) * np.where(elements[shift:] == elements[:-shift], 1.0, APART)
        total[shift:] += w * ratio[:-shift]
        total[:-shift] += w * ratio[shift:]
        weight[shift:] += w
        weight[:-shift] += w
    smooth = total / weight
    smooth = np.log1p(smooth)
    threshold = smooth.mean()
    for _ in range(50):
        upper = smooth >= threshold
        if upper.all():
            break
        before, threshold = threshold, (smooth[upper].mean() + smooth[~upper].mean()) / 2
        if abs(threshold - before) < 1e-9:
            break
    return smooth >= min(threshold, smooth.max(), math.log1p(TEXT))


def parse(html: str) -> Lines:
    """The lines of a page."""
    tail = html.rfind(">") + 1
    if unended := re.compile(r"<[A-Za-z/!?]").search(html, tail):
        html = html[: unended.start()]
    page = Lines()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):
        page._end_line()
    return page


def main_text(html: str) -> str:
    """The article's blocks in page order, one a line."""
    page = parse(html)
    if not page.texts:
        return ""
    lengths = np.fromiter(map(len, page.texts), np.int64, len(page.texts))
    elements, parents = np.array(page.elements), page.parents
    core = content_lines(lengths, np.array(page.tags), elements)

    def summed(at: np.ndarray, values) -> np.ndarray:
        """The values of each element and of all that it holds."""
        held = np.zeros(len(parents), np.int64)
        np.add.at(held, at, values)
        for element in range(len(held) - 1, 0, -1):  # children come after their parents
            held[parents[element]] += held[element]
        return held

    def handed_down(values: np.ndarray) -> np.ndarray:
        """The values of each element and of all that it is in."""
        out = values.astype(np.int64)
        for element in range(1, len(parents)):
            out[element] += out[parents[element]]
        return out

    content = np.where(core, lengths, 0)
    held = summed(elements, content)
    named = np.zeros(len(parents), np.int64)
    named[[e for e in page.articles if held[e]]] = 1
    around, within = handed_down(named) - named, summed(np.arange(len(parents)), named)
    suspect = np.zeros(len(parents), np.int64)
    for e in page.suspects:  # a wrapper holds nearly all content, and every article is in it or around it
        wraps = held[e] >= (NAMED_SHARE if e in page.named else SHARE) * held[0] and within[e] + around[e] == within[0]
        suspect[e] = not wraps
    gone = handed_down(suspect) > 0
    kept = ~gone[elements]
    held = summed(elements, np.where(kept, content, 0))
    need = math.ceil(SHARE * held[0])
    chosen = next((e for e in page.articles if not gone[e] and held[e] >= need and held[e]), 0)
    if not chosen:
        for element in range(1, len(held)):
            if parents[element] == chosen and held[element] == held[0] > 0:
                chosen = element
        heads = np.array(page.heads)
        kept &= heads | (np.array(page.linked) < LINKS * lengths)
        text, headed = summed(elements, np.where(kept, lengths, 0)), summed(elements, kept & heads)
        while chosen and headed[parents[chosen]] > headed[chosen] and text[chosen] >= SHARE * text[parents[chosen]]:
            chosen = parents[chosen]  # the headline stands in an element of its own
    root = np.zeros(len(parents), np.int64)
    root[chosen] = 1
    kept &= handed_down(root)[elements] > 0
    return "\n".join(t for t, k in zip(page.texts, kept, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with `main_text` and without the html column."""
    keep = [c for c in pages.columns if c not in (html_col, "main_text")]
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = pages.select(kept.alias("row"), text_column(pages, html_col).alias("html"))

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(1).to_pylist()], pa.string())
            yield pa.record_batch([batch.column(0), texts], names=["row", "main_text"])

    schema = rows.select("row", F.lit("").alias("main_text")).schema
    out = rows.mapInArrow(compute, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "main_text")
