"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Text between two block tags is a line, with the tags met in it
and the elements it stands in. A line's ratio is its characters by its tags; ratios are smoothed along the page by a
Gaussian, and lines above a threshold (a share of the spread of all ratios, at most their mean) are content. The region
is the article or main element with most of the content, or else the smallest element that holds nearly all of it; of
the region every line stays, short ones too, but for lines of what is never main text: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, hidden parts and reader comments, told by element, role or words of class and
id, and runs of lines that are links only.

Defined cases: null or empty html, or a page without text, gives the empty text; repeated ids and rows stay rows of
their own; a page cut off anywhere is read to its end, and open elements end there; all work is linear in the page,
whatever its length, and no page meets another one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their part in a page.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
REJECTED = set("nav footer aside form script style noscript template iframe object svg math canvas audio video select button textarea dialog menu search head title".split())
INLINE = set("a abbr acronym b big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var script style noscript template select svg math button".split())
#: Elements whose start ends an open p, and what ends an open element of the same list.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that mark what isn't main text.
MARKS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead topbar cookie cookies consent gdpr notice notices notification notifications disclaimer popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist respond replies reply disqus discussion share sharing social related recommended recommendations toolbar pagination pager paging skip".split()
)
#: Of these, a header's words: they hold outside articles only, whose own header bears the title.
HEADERS = {"header", "masthead"}
OF_ARTICLES = {"comment", "reply", "ad", "advert", "sponsored", "promo"}
WHOLE = {"html", "body", "main"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

SIGMA = 1.0
SPREAD = 0.5
#: Share of the content that the smallest enclosing element has to hold.
NEARLY_ALL = 0.8
#: An article is the region if it holds so large a share of the content.
ARTICLE = 0.3
LINK_RUN = 3


def _words(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))


class Lines(HTMLParser):
    """Lines of a page: text, tags, characters in links, and the innermost element; elements as parallel lists."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.at: list[int] = []
        self.names, self.up, self.marked, self.bad = ["#page"], [-1], [False], [False]
        self.open = [0]
        self.mute = 0
        self.count: dict[str, int] = {}
        self.pieces: list[str] = []
        self.seen = self.in_link = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers of the source aren't needed."""
        return j

    def flush(self) -> None:
        if not self.pieces:
            self.seen = self.in_link = 0
            return
        text = " ".join("".join(self.pieces).split())
        if text:
            self.texts.append(text)
            self.tags.append(self.seen)
            self.linked.append(min(self.in_link, len(text)))
            self.at.append(self.open[-1])
        self.pieces, self.seen, self.in_link = [], 0, 0

    def close_until(self, tag: str, stop: set[str] | None = None) -> None:
        """Ends the innermost open element of this name, and all in it, unless one in stop is nearer."""
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.names[self.open[k]]
            if name == tag:
                for i in self.open[k:]:
                    self.count[self.names[i]] -= 1
                    self.mute -= self.names[i] in INLINE and (self.bad[i] or self.marked[i])
                del self.open[k:]
                return
            if stop and name in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen += 1
        if tag == "br" or tag == "img":
            self.pieces.append(" ")
        if tag in BLOCKS:
            self.flush()
            self.close_until("p", {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            self.close_until(tag, SIBLINGS[tag])
        if tag in VOID:
            return
        in_article = bool(self.count.get("article") or self.count.get("main"))
        bad, marked = tag in REJECTED or tag == "header" and not in_article, False
        if attrs and tag not in WHOLE:
            own = {k: v or "" for k, v in attrs}
            words = _words(f"{own.get('class', '')} {own.get('id', '')}") if "class" in own or "id" in own else set()
            # a post "with comments" is a post
            marked = bool(words & OF_ARTICLES) if tag == "article" else bool(words & MARKS or not in_article and words & HEADERS)
            bad |= "hidden" in own or own.get("aria-hidden") == "true" or own.get("role") in ROLES or "style" in own and bool(HIDDEN.search(own["style"]))
        self.names.append(tag)
        self.up.append(self.open[-1])
        self.marked.append(marked)
        self.bad.append(bad)
        self.open.append(len(self.names) - 1)
        self.mute += tag in INLINE and (self.bad[-1] or self.marked[-1])
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            self.close_until(tag)

    def handle_data(self, data: str) -> None:
        if self.mute:  # what is no main text within a line
            return
        self.pieces.append(data)
        if self.count.get("a"):
            self.in_link += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; beyond its ends weights are left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def content(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines are content, and the threshold: SPREAD standard deviations of the smoothed ratios, or their mean if
    that is less."""
    near = smoothed(ratios)
    threshold = min(SPREAD * near.std(), near.mean())
    return near >= threshold, threshold


def main_text(html: str | None) -> str:
    """The lines of the main region, joined by newlines."""
    page = Lines()
    page.feed((html or "").replace("\0", ""))
    if re.match("<[a-zA-Z/!?]", page.rawdata):  # a tag that the page's end cuts off
        page.rawdata = ""
    page.close()
    page.flush()
    if not page.texts:
        return ""
    n, up, names = len(page.names), page.up, page.names
    # what holds an article, a main element or the title of the page is no advert, whatever its class says
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        if holds[i] or names[i] == "main" or names[i] == "article" and not page.marked[i]:
            holds[up[i]] = True
    out = [False] * n
    article = [-1] * n
    for i in range(1, n):  # parents come before their children
        inner = page.marked[i] and not holds[i] and names[i] not in ("h1",)
        out[i] = out[up[i]] or page.bad[i] or inner
        article[i] = i if article[up[i]] < 0 and names[i] in ("article", "main") else article[up[i]]
    at = np.array(page.at)
    length = np.array([len(t) for t in page.texts], dtype=float)
    tags = np.array(page.tags, dtype=float)
    usable = ~np.array(out)[at]
    if not usable.any():
        return ""
    # the ratios of lines that are out count as nothing, so that smoothing knows where a region ends
    ratios = np.where(usable, length, 0.0) / np.maximum(tags, 1.0)
    chosen, threshold = content(ratios)
    chosen &= usable
    if not chosen.any():
        chosen = usable
    weight = np.where(chosen, length, 0.0)
    held = np.bincount(at, weights=weight, minlength=n)
    for i in range(n - 1, 0, -1):
        held[up[i]] += held[i]
    articles = [i for i in range(1, n) if article[i] == i and not out[i]]
    region = max(articles, key=lambda i: held[i], default=-1)
    if region < 0 or held[region] < ARTICLE * held[0]:
        region = max((i for i in range(n) if held[i] >= NEARLY_ALL * held[0] and (i == 0 or names[i] in BLOCKS and names[i] not in ("p", "li"))))
    elif names[region] == "main":  # of several articles in it, that with most of the content
        inner = [i for i in range(region + 1, n) if names[i] == "article" and not out[i] and held[i] >= NEARLY_ALL * held[region]]
        region = max(inner, default=region)
    inside = [False] * n
    inside[region] = True
    for i in range(region + 1, n):
        inside[i] = inside[up[i]]
    keep = usable & np.array(inside)[at]
    keep &= ~link_runs(np.array(page.linked) >= 0.9 * length, keep & (ratios < threshold))
    return "\n".join(page.texts[i] for i in np.flatnonzero(keep))


def link_runs(links: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Lines in runs of at least LINK_RUN lines, among those given, that are links only: a menu without a mark."""
    hit = links & among
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out = np.zeros(len(hit), dtype=bool)
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        out[lo:hi] = hi - lo >= LINK_RUN
    return out


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars (code points) of every row."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)

    extracted = F.pandas_udf(texts, "string")
    out = pages.select(*keep, F.col(html).alias("_html")).withColumn("text", extracted("_html"))
    return out.select(*keep, "text", F.length("text").cast("long").alias("n_chars"))
