"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events. Each block element gives a line of text, with the number of tags met in it and
the characters that stand in links. Elements that are never content (menus, headers, footers, sidebars, adverts, scripts, styles,
reader comments, told by tag, role, class or id) give no lines. Forms, and elements whose class or id may mean a part of the page as
well as the page, give none either, unless they only wrap the page. May mean: a word of WEAK, and any mark that is a part of a longer
name (header-fixed, menu-open) or one of several names (page sidebar); names with, has and no in them say nothing (page-with-sidebar).
What such an element wraps is told by what it holds: the main element, or half of the page's text; a first heading, too, in one of WEAK
and a form, and an article in a form. One that is marked as comments or teasers has to hold an article besides half of the text.

An article inside of an article, which is a remark or an entry about the outer one, goes unless it holds half of the outer one's text. Of
several articles side by side, those with less than TEASER of the longest one's text go if they have a link, by which they lead to
pages of their own; articles of like lengths, as on a page of entries, and short ones without a link all stay.

Over the lines, the logarithm of the ratio of text outside of links to tags is smoothed by a Gaussian, and the smoothed values are cut
at a share of their mean. Lines of text above the cut are content; inside an article or the main element, which is the prior, the cut
is at a lower share, so that short paragraphs there stay. Where the page has no such element, content goes from the first to the last
line above the cut. Neighbouring lines that are nothing but links form clusters of their own, two lines or more, which go if their mean
is below that share of the mean of the other lines, wherever they are.

White space inside a block becomes one space, blocks are trimmed and joined by one \\n; a line break counts as white space.

Defined results: null and empty pages have the empty text; markup that is broken off or not closed is read as far as it goes, in time
linear in its length; a page of a single block is that block; equal ratios are judged alike; very long pages are read whole; repeated
rows give repeated rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import batches_of, short_batches, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("script style noscript template head title nav footer aside button select textarea option iframe object embed svg canvas audio video menu dialog datalist fieldset map applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form tablist status".split())
#: Words in a class or id that mark what is not content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense banner sponsor sponsored sponsors promo promos promotion"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot header masthead topbar toolbar"
    " comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr newsletter subscribe subscription"
    " related recommended recommendations teaser pagination pager disclaimer".split()
)
#: Words that mark what is not content, unless it wraps the content.
WEAK = frozenset("alert copyright form hidden legal login modal notice notices notification overlay paging popup print rail search share sharing signup skip social tracking widget widgets".split())
NOT_A_MARK = frozenset("no has with without free".split())
#: Marks of parts that may be longer than the content.
SOCIAL = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended recommendations teaser".split())
#: Parts of the page, by what marks them, and what a part may hold.
PAGE, FORM, MAYBE, PART, CROWD = range(5)
MAIN, FIRST_HEADING, ARTICLE = 1, 2, 4
#: Elements that the start of another block closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
WITHIN = ("div", "section", "article", "main", "td", "th", "li", "blockquote", "body", "nav", "aside", "header", "footer", "form")
LISTS = ("ul", "ol", "dl", "table", "select")
SIGMA = 1.0
#: Share of the longest article's text below which another article with a link is a teaser.
TEASER = 0.25
#: Share of the mean smoothed ratio at which lines are cut, and the share inside the prior's regions.
LEVEL, REGION_LEVEL = 0.5, 0.1


def marked(attrs: list[tuple[str, str | None]]) -> tuple[bool, int]:
    """What an element's attributes say: whether it is not content, and else which part of the page it may be (PAGE: none)."""
    found = PAGE
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            names = value.split()
            for one in names:
                parts = one.replace("_", "-").split("-")
                if NOT_A_MARK.isdisjoint(parts):
                    if not MARKS.isdisjoint(parts):
                        if len(names) == len(parts) == 1:
                            return True, PAGE
                        found = max(found, PART if SOCIAL.isdisjoint(parts) else CROWD)
                    elif not WEAK.isdisjoint(parts):
                        found = max(found, MAYBE)
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, PAGE
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True, PAGE
    return False, found


class Lines(HTMLParser):
    """Collects a line for each block that may be content: (text, tags, characters in links, whether it is in an article or the main
    element, the part of the page it is in, the innermost article). No event costs more than the elements that it closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int, int]] = []  # tag, whether it starts something to skip, and region, part and article outside of it
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # where each tag is open
        self.blocks: list[int] = []  # where blocks are open
        self.skipped = 0
        self.region = False
        self.part = self.article = 0
        self.articles = [0]  # the article around it; the first is the page
        self.parts = [(0, PAGE)]  # (the part around it, what it is)
        self.holds = [0]  # what a part holds that only a wrapper does
        self.pieces: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, bool, int, int]] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.region, self.part, self.article))
        self.pieces, self.tags, self.linked = [], 0, 0

    def pop(self, n: int) -> None:
        """Close the elements from depth n on."""
        while len(self.open) > n:
            tag, skips, region, part, article = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
                self.end_line()
            self.skipped -= skips
            self.region, self.part, self.article = region, part, article

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def shut(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the innermost of some elements, if it is inside the innermost of those that may hold it."""
        at = self.last(tags)
        if at >= 0 and at > self.last(within):
            self.pop(at)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.shut(("p", *HEADINGS) if tag not in HEADINGS else ("p",), WITHIN)
            if tag in CLOSES:
                self.shut(CLOSES[tag], LISTS)
            self.end_line()
        elif tag in ("br", "td", "th"):
            self.pieces.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        skips = tag in NEVER or tag == "header" and not self.region
        kind = FORM if tag == "form" else PAGE
        if not skips and tag not in ("html", "body", "article", "main", "header") and attrs:
            skips, mark = marked(attrs)
            kind = max(kind, mark) if tag != "form" or mark > MAYBE else FORM
        if not skips and self.places["header"] and tag in BLOCKS and tag not in HEADINGS and tag not in ("div", "hgroup", "section"):
            skips = True  # an article's own header: its headings only
        self.places[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, skips, self.region, self.part, self.article))
        self.skipped += skips
        if self.skipped:
            return
        if tag in ("main", "h1", "article"):
            self.holds[self.part] |= MAIN if tag == "main" else FIRST_HEADING if tag == "h1" else ARTICLE
            if tag == "article" and self.parts[self.part][1] == FORM:
                self.holds[self.part] |= FIRST_HEADING
        if tag == "article":
            self.articles.append(self.article)
            self.article = len(self.articles) - 1
        if tag in ("article", "main"):
            self.region = True
        elif kind != PAGE:
            self.parts.append((self.part, kind))
            self.holds.append(0)
            self.part = len(self.parts) - 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        at = self.places[tag][-1] if self.places[tag] else -1
        if at >= 0 and (tag in BLOCKS or not self.blocks or self.blocks[-1] < at):
            self.pop(at)

    def handle_data(self, data):
        if not self.skipped:
            self.pieces.append(data)
            link = self.places["a"]
            if link and (not self.blocks or self.blocks[-1] < link[-1]):  # a link around blocks, or one that is not closed, makes no link of them
                self.linked += len("".join(data.split()))

    def finished(self) -> list[tuple[str, int, int, bool]]:
        """The lines, without those of parts that are no wrappers and of articles that are remarks or teasers."""
        self.close()
        self.pop(0)
        self.end_line()
        sizes = [0] * len(self.parts)
        for text, *_, part, _ in self.lines:
            sizes[part] += len(text)
        for i in range(len(self.parts) - 1, 0, -1):  # a part comes after the one around it
            around = self.parts[i][0]
            sizes[around] += sizes[i]
            self.holds[around] |= self.holds[i]
        stays = [True]
        for i in range(1, len(self.parts)):
            around, kind = self.parts[i]
            enough = MAIN | FIRST_HEADING if kind in (FORM, MAYBE) else MAIN
            half = 2 * sizes[i] >= sizes[0] and (kind != CROWD or self.holds[i] & ARTICLE)
            stays.append(bool(stays[around] and (self.holds[i] & enough or half)))
        lines = [x for x in self.lines if stays[x[4]]]
        stays = self.articles_that_stay(lines)
        return [x[:4] for x in lines if stays[x[5]]]

    def articles_that_stay(self, lines: list[tuple[str, int, int, bool, int, int]]) -> list[bool]:
        """For each article, the page being the first, whether it is content."""
        sizes, links = [0] * len(self.articles), [0] * len(self.articles)
        for text, _, linked, *_, article in lines:
            sizes[article] += len(text)
            links[article] += linked
        for i in range(len(sizes) - 1, 0, -1):  # an article comes after the one around it
            sizes[self.articles[i]] += sizes[i]
        longest = max((n for n, around in zip(sizes[1:], self.articles[1:]) if not around), default=0)
        stays = [True]
        for i, around in enumerate(self.articles[1:], 1):
            teaser = sizes[i] < TEASER * longest and links[i] > 0
            stays.append(stays[around] and (2 * sizes[i] >= sizes[around] if around else not teaser))
        return stays


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with a window of three sigmas, renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(weights[j - i + reach], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def chosen(lines: list[tuple[str, int, int, bool]]) -> list[bool]:
    """Which lines are content, by their smoothed ratios."""
    texts_ = [max(0, len("".join(text.split())) - linked) for text, _, linked, _ in lines]
    ratios = smooth([math.log1p(n / max(1, tags)) for n, (_, tags, _, _) in zip(texts_, lines)])
    cut = LEVEL * sum(ratios) / len(ratios)
    links = [not n for n in texts_]
    own = [x for x, link in zip(ratios, links) if not link]
    link_cut = LEVEL * sum(own) / max(1, len(own))
    if any(region for *_, region in lines):
        keep = [region and (link or x >= cut * REGION_LEVEL / LEVEL) for x, link, (*_, region) in zip(ratios, links, lines)]
    else:
        above = [i for i, x in enumerate(ratios) if x >= cut and not links[i]] or [i for i, x in enumerate(ratios) if x >= cut]
        keep = [above[0] <= i <= above[-1] for i in range(len(lines))]
    i = 0
    while i < len(lines):
        j = i + 1
        while links[i] and j < len(lines) and links[j]:
            j += 1
        if j - i > 1 and sum(ratios[i:j]) < link_cut * (j - i):
            keep[i:j] = [False] * (j - i)
        i = j
    return keep


def extract(html: str) -> str:
    """The main text of a whole page."""
    parser = Lines()
    parser.feed(html)
    lines = parser.finished()
    return "\n".join(line[0] for line, stays in zip(lines, chosen(lines)) if stays) if lines else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html). Narrow: no shuffle."""
    import pyarrow as pa

    short_batches(pages.sparkSession)
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(batches):
        for batch in batches:
            for k, u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "html")):
                t = extract(h)
                yield k, u, t, len(t)

    def run(batches):
        yield from batches_of(rows(batches), out, 200)

    return pages.select(pages["page_id"].cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
