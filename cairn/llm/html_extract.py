"""Main text of web pages: streamed parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's HTML parser streams events; every block-level element closes a line. A line's score is the logarithm of
its text-to-tag ratio, in which link text does not count, and text in page furniture (by element, role, class or id) counts ``FURNITURE_WEIGHT``. The scores of all
lines in page order are smoothed by a Gaussian, lines of furniture and others apart, ``ARTICLE_PRIOR`` is added within ``article`` and ``main``, and the page is split in two
clusters by a threshold (two-means in one dimension, at most ``CEILING``); the lines above it are content. Clusters less than ``GAP`` apart are one, which
is content if its mean is above ``FLOOR``: a page whose lines are alike is kept or left as a whole.

Regions: an element is a content region if more than half of the text in it, counted without furniture inside it, is in content lines. All lines of
a region stay, however short. A piece of furniture is a region only by its own lines. Lines that stand
directly in the page stay from the first to the last content line among them, with the headings above the first and less those made of links. Where one region of several lines holds most of the
content, branches of the page beside it with less than ``SIDE_SHARE`` of its content are not part of the text, but for headings and paragraphs.
Scripts, styles, the head and hidden elements are no text at all.

Defined cases: null or empty html gives an empty text; a page without markup is one line; blocks repeat if the page repeats them; elements that are
never closed end with the page, end tags without a start are ignored; a null url stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 0.6
CEILING = 2.5
ARTICLE_PRIOR = 0.5
FURNITURE_WEIGHT = 0.01
GAP, FLOOR = 1.5, 1.0
#: Share of the main region's content from which a branch beside it counts.
SIDE_SHARE = 0.15
#: Share of the largest region's content that an inner one must hold to be the main region.
MAIN_SHARE = 0.75
#: Share of link text from which a line directly in the page is a menu.
LINKED = 0.6
# Elements that close a line, elements without an end tag, elements without text, and page furniture.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
VOIDS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th".split())
UNSEEN = frozenset("canvas head iframe math noscript object script style svg template title".split())
FURNITURE = frozenset("aside button datalist dialog fieldset footer form input label menu nav search select textarea".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | {"p"}


def is_unseen(tag: str, values: dict[str, str]) -> bool:
    return tag in UNSEEN or "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")) is not None


def is_furniture(tag: str, values: dict[str, str], in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if tag in ARTICLES or not values:
        return False
    names = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{values.get('class', '')} {values.get('id', '')}").lower())
    return values.get("role", "").lower() in ROLES or not NAMES.isdisjoint(names)


class _Lines(HTMLParser):
    """Collects lines [text, tags, length of link text, element] and the elements' parents, furniture, articles and tags. Element 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.furniture, self.article, self.tag = [0], [False], [False], [""]
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, unseen
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _close_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.stack[-1][1]))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in FURNITURE or tag in UNSEEN:
            self._close_line()
            if tag == "p" and self.stack[-1][0] == "p":
                self._pop(len(self.stack) - 1)
        if tag in SPACED:
            self.parts.append(" ")
        self.tags += 1
        if tag in VOIDS:
            return
        _, element, unseen = self.stack[-1]
        if not unseen and tag not in ("html", "body"):
            values = {k: v or "" for k, v in attrs}
            unseen = is_unseen(tag, values)
            furniture = is_furniture(tag, values, self.article[element])
            if tag in BLOCKS or furniture:
                self.parent.append(element)
                self.tag.append(tag)
                # an article within a banner or menu of the page is still one
                self.furniture.append(furniture or self.furniture[element] and not (tag in ARTICLES and not self.article[element]))
                self.article.append(self.article[element] or tag in ARTICLES)
                element = len(self.parent) - 1
        self.open[tag] += 1
        self.stack.append((tag, element, unseen))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOIDS:
            self.handle_endtag(tag)

    def _pop(self, at: int) -> None:
        for tag, _, _ in self.stack[at:]:
            self.open[tag] -= 1
        del self.stack[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in FURNITURE or tag in UNSEEN:
            self._close_line()
        self.tags += 1
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                break
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                break  # an inline end tag doesn't close the blocks around it

    def handle_data(self, data: str) -> None:
        if self.stack[-1][2]:
            return
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len(data)

    def finish(self) -> list[tuple[str, int, int, int]]:
        self.close()
        self._close_line()
        return self.lines


def smoothed(scores: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Each score with its neighbours, weighted by a Gaussian; the ends are repeated."""
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(scores, radius, mode="edge"), kernel / kernel.sum(), mode="valid") if len(scores) else scores


def content_lines(scores: np.ndarray, ceiling: float = CEILING) -> np.ndarray:
    """Which lines belong to the upper of two clusters of the scores."""
    low, high = scores.min(), scores.max()
    cut = (low + high) / 2
    for _ in range(50):
        if high - low < 1e-9:
            break
        upper = scores > cut
        low, high = scores[~upper].mean(), scores[upper].mean()
        if abs((low + high) / 2 - cut) < 1e-9:
            break
        cut = (low + high) / 2
    if high - low < GAP:
        return np.full(len(scores), scores.mean() > FLOOR)
    return scores > min(cut, ceiling)


def line_scores(ratio: np.ndarray, furniture: np.ndarray, article: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Smoothed scores of the lines of a page from their text-to-tag ratios and where they stand."""
    out = np.log1p(np.where(furniture, FURNITURE_WEIGHT, 1.0) * ratio)
    for kind in (furniture, ~furniture):
        out[kind] = smoothed(out[kind], sigma)
    return out + np.where(article, ARTICLE_PRIOR, 0.0)


def regions(parser: _Lines, content: np.ndarray) -> list[bool]:
    """For each line: does it stand in a content region?"""
    size, hit, count = ([0] * len(parser.parent) for _ in range(3))
    for (text, _, _, element), c in zip(parser.lines, content):
        size[element] += len(text)
        hit[element] += len(text) if c else 0
        count[element] += 1
    inherits = [False] + [parser.furniture[e] == parser.furniture[parser.parent[e]] for e in range(1, len(size))]
    for e in range(len(size) - 1, 0, -1):  # children have higher numbers than their parents
        if inherits[e]:
            size[parser.parent[e]] += size[e]
            hit[parser.parent[e]] += hit[e]
            count[parser.parent[e]] += count[e]
    inside = [False] * len(size)
    for e in range(1, len(size)):
        inside[e] = 2 * hit[e] > size[e] or inherits[e] and inside[parser.parent[e]]
    side = _side(parser, hit, count)
    direct = [parser.parent[e] == 0 and not parser.furniture[e] and not side[e] for *_, e in parser.lines]  # in the page itself, or in a block of it
    at = [i for i, d in enumerate(direct) if d and content[i]]
    first, last = (at[0], at[-1]) if at else (0, -1)
    while at and first and direct[first - 1] and parser.tag[parser.lines[first - 1][3]] in HEADINGS:
        first -= 1
    return [not side[e] and inside[e] or direct[i] and first <= i <= last and linked <= LINKED * len(text) for i, (text, _, linked, e) in enumerate(parser.lines)]


def _side(parser: _Lines, hit: list[int], count: list[int]) -> list[bool]:
    """For each element: does it stand in a small branch beside the main region? That is the innermost element of several lines with nearly all content of the largest."""
    parent, out = parser.parent, [False] * len(parser.parent)
    wide = [e for e in range(1, len(hit)) if count[e] > 1 and not parser.furniture[e]]
    most = max((hit[e] for e in wide), default=0)
    if 2 * most <= hit[0]:
        return out
    main = max(e for e in wide if hit[e] >= MAIN_SHARE * most)
    above, e = {0, main}, main
    while e:
        e = parent[e]
        above.add(e)
    for e in range(1, len(hit)):
        if e not in above:
            branch = parent[e] in above and parent[e] != main
            out[e] = hit[e] < SIDE_SHARE * hit[main] and parser.tag[e] not in PARAGRAPHS and not parser.article[e] if branch else out[parent[e]]
    return out


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    ratio = np.array([max(0, len(text) - linked) / max(1, tags) for text, tags, linked, _ in lines])
    elements = [e for *_, e in lines]
    scores = line_scores(ratio, np.array([parser.furniture[e] for e in elements]), np.array([parser.article[e] for e in elements]), sigma)
    return "\n\n".join(text for (text, *_), kept in zip(lines, regions(parser, content_lines(scores))) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = SIGMA) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [main_text(h.as_py(), sigma) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])

    kind, url = (base.schema[c].dataType.simpleString() for c in ("_id", "_url"))
    out = base.mapInArrow(run, f"_id {kind}, _url {url}, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
