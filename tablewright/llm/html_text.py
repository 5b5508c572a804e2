"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's streaming parser turns a page into lines, one per block of text. Each line
has the ratio of its text to its tags; the ratios are smoothed by a Gaussian along the page and
clustered by a threshold. The content region is all articles that hold a line of the dense cluster,
or, without articles, the smallest element around all of its dense lines. Every line of the region is
kept, short ones too, without what markup itself declares to be something else.

What a class or a role declares is taken back where it cannot be meant: an element that holds the only
article of the page is not beside it, nor is one that holds nearly all of the text and is also called
something else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Elements that hold no text to read, or text beside the article. Fixed by the HTML standard.
HIDDEN = frozenset("script style noscript template svg math head title iframe object canvas".split())
CONTROLS = frozenset("button select textarea".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div body td".split())
#: Elements whose start ends an open paragraph. Fixed by the HTML standard.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Words that name what is not the article, in classes, ids and roles. Fixed values.
BESIDE = (
    r"(ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|alert|popup|modal|nav\w*|"
    r"menu|breadcrumbs?|sidebar|side-bar|footer|header|masthead|comments?|disqus|respond|reply|"
    r"replies|share|sharing|social|related|recommend\w*|subscribe|newsletter|login|signup|search|"
    r"toolbar|pagination|pager|complementary|contentinfo|navigation|dialog)"
)
#: A class is such a name as a whole, by the word it begins with, or by the word it ends with; not
#: where it begins by saying that the element only has one, nor for the header of an article.
FIRST = re.compile(rf"{BESIDE}([-_]|$)", re.IGNORECASE)
LAST = re.compile(rf"{BESIDE}$", re.IGNORECASE)
HAVING = frozenset("has have with without no is not show hide toggle".split())
OWNERS = frozenset("post entry article content story page main".split())
LEAST_TEXT = 60  # code points of a line that is text by its length alone
LITTLE = 20  # text outside an element is little if it is less than one part in so many
SIGMA = 1.0  # of the Gaussian, in lines
SPACE = re.compile(r"[\s\x00]+")


def is_beside(name: str) -> bool:
    """Whether a class, an id or a role names what is not the article."""
    if FIRST.match(name):
        return True
    words = name.replace("_", "-").lower().split("-")
    if words[0] in HAVING or not LAST.match(words[-1]):
        return False
    return not (words[-1] == "header" and words[0] in OWNERS)


class _Lines(HTMLParser):
    """Lines of a page: text, tags, text in links, the elements around it, and those of them that
    are called something beside the article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, number, hidden, beside
        self.lines: list[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]] = []
        self.pieces: list[str] = []
        self.tags = self.linked = self.count = self.links = 0
        self.articles: dict[int, tuple[str, tuple[int, ...]]] = {}  # tag, what is beside around it
        self.mixed: set[int] = set()  # called something beside the article and something else

    def line(self):
        text = SPACE.sub(" ", "".join(self.pieces)).strip()
        if text:
            path = tuple(number for tag, number, _, _ in self.open if tag in CONTAINERS)
            self.lines.append((text, self.tags, self.linked, path, self.beside()))
            self.tags = self.linked = 0
        self.pieces = []

    def beside(self) -> tuple[int, ...]:
        return tuple(number for _, number, _, beside in self.open if beside)

    def skipped(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in ENDS_PARAGRAPH:
            self.close("p")
        if tag == "li":
            self.close("li", "ul ol menu")
        if tag not in INLINE:
            self.line()
        if tag in VOID:
            return
        names = [n for k, v in attrs if k in ("class", "id", "role") and v for n in v.split()]
        # A page, its body, an article and its heading are never beside themselves.
        owned = tag in ("html", "body", "article", "main")
        named = [] if owned else [n for n in names if is_beside(n)]
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        # The header of an article is part of it only for its heading, so it goes as any header.
        beside = tag in ASIDE or bool(named)
        out = self.skipped() or tag in HIDDEN or tag in CONTROLS or hidden
        self.count += 1
        if tag in ("article", "main") and not out:
            self.articles[self.count] = (tag, self.beside())
        if named and tag not in ASIDE and len(named) < len(names):
            self.mixed.add(self.count)
        self.links += tag == "a"
        self.open.append((tag, self.count, out, beside))

    def cut(self, i: int):
        """Forget the open elements from ``i`` on."""
        self.links -= sum(tag == "a" for tag, *_ in self.open[i:])
        del self.open[i:]

    def close(self, tag: str, limits: str = ""):
        """End the innermost open ``tag``, unless a block or one of ``limits`` stands between."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self.line()
                self.cut(i)
                return
            if name not in INLINE and (not limits or name in limits.split()):
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.cut(i)
                return
            # An end tag reaches over inline elements and paragraphs, not out of a block.
            if tag in INLINE and self.open[i][0] not in INLINE:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.skipped():
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self, html: str):
        self.feed(html)
        self.close_input()
        self.line()
        return self

    def close_input(self):
        super().close()


def _smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    sums = np.convolve(ratios, weights, "full")[reach : reach + len(ratios)]
    norms = np.convolve(np.ones(len(ratios)), weights, "full")[reach : reach + len(ratios)]
    return sums / norms


def _dense(ratios: np.ndarray) -> np.ndarray:
    """Two clusters on a line: above or below a threshold halfway between their means."""
    threshold = ratios.mean()
    for _ in range(20):
        high = ratios >= threshold
        if high.all() or not high.any():
            break
        halfway = (ratios[high].mean() + ratios[~high].mean()) / 2
        if halfway == threshold:
            break
        threshold = halfway
    return ratios >= min(threshold, ratios.max())


def _taken_back(page: _Lines, lengths: np.ndarray) -> set[int]:
    """Elements that are called something beside the article and are not."""
    back: set[int] = set()
    articles = [around for _, around in page.articles.values()]
    if articles:
        if all(articles):
            # No article stands free: those with the most text are what the page is about.
            inside = {number: 0 for number in page.articles}
            for (_, _, _, path, _), length in zip(page.lines, lengths.tolist()):
                for number in path:
                    if number in inside:
                        inside[number] += length
            back |= set(page.articles[max(inside, key=lambda n: (inside[n], -n))][1])
        return back
    total = int(lengths.sum())
    held: dict[int, int] = {}
    for (_, _, _, _, beside), length in zip(page.lines, lengths.tolist()):
        for number in beside:
            held[number] = held.get(number, 0) + length
    # From the outside in, so that what is beside within a taken back element stays so.
    for number in sorted(page.mixed):
        if (total - held.get(number, 0)) * LITTLE < total:
            back.add(number)
    return back


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The main text of a page, one line per block (empty without any)."""
    page = _Lines().finish(html or "")
    if not page.lines:
        return ""
    unlinked = np.array([len(line[0]) - min(line[2], len(line[0])) for line in page.lines])
    back = _taken_back(page, unlinked)
    shown = [i for i, line in enumerate(page.lines) if back.issuperset(line[4])]
    if not shown:
        return ""
    lines, lengths = [page.lines[i] for i in shown], unlinked[shown]
    ratios = lengths / np.maximum([line[1] for line in lines], 1)
    dense = _dense(_smooth(ratios, sigma))
    # A line of links is no text, however dense its neighbours are; a line as long as those of the
    # cluster is text, however many tags an element that ends or begins there has.
    usual = np.median(lengths[dense]) if dense.any() else 0
    text = dense | (lengths >= max(LEAST_TEXT, usual / 2))
    paths = [line[3] for line, t, n in zip(lines, text, lengths) if t and 2 * n >= len(line[0])]
    free = {n: tag for n, (tag, around) in page.articles.items() if back.issuperset(around)}
    region = _articles(paths, free) or set(free) or _around(paths)
    return "\n".join(line[0] for line in lines if region is None or region.intersection(line[3]))


def _articles(paths: list[tuple[int, ...]], free: dict[int, str]) -> set[int]:
    """The outermost articles around dense lines; their ``main`` where it has dense lines besides."""
    found: set[int] = set()
    for tags in (("article",), ("article", "main")):
        outer = [next((n for n in path if free.get(n) in tags), None) for path in paths]
        found = {n for n in outer if n is not None}
        inside = [any(n in free for n in path) for path in paths]
        if found and all(o is not None for o, i in zip(outer, inside) if i):
            return found
    return found


def _around(paths: list[tuple[int, ...]]) -> set[int] | None:
    """The smallest element around all of the lines; None where there is none."""
    if not paths:
        return None
    common = set(paths[0]).intersection(*paths)
    return {max(common)} if common else None


def extract(pages: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """All columns of ``pages`` with ``text_column`` added (or replaced), one row per row.

    The text of a page is that of :func:`main_text`: the article without menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments, with character references
    decoded, white space inside a block as one blank, and blocks joined by a line feed. NULL, empty
    and text-free pages give empty text. A page is parsed whole, whatever its length and depth, and no
    row moves, so the work is one pass over the pages. Repeated rows are answered each, an empty table
    gives no rows, and other columns stay, whatever their names.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn(text_column, texts(F.coalesce(F.col(html_column), F.lit(""))))
