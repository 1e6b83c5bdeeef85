"""Main text of web pages by tag-path ratios.

Per page, every block of text has a path of structural tags from the root; inline tags are part of its text. Text length,
punctuation and the share of links are added up per path; length and punctuation are smoothed over the blocks in page order
by geometric means, so that a strong neighbour cannot lift a weak path over the threshold, and fused with the share of links
and with what the tags of the path say of themselves. Paths above a share of the strongest are content. The text is the
blocks on content paths, the blocks between them and in the same ``article`` that are neither links nor marked as something
else, and the headings in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags whose text is never shown as text of the page.
HIDDEN_TAGS = frozenset(
    "script style noscript template head title button select option textarea iframe svg math object canvas audio video map datalist".split())
#: How likely a path through one of these tags is content, against one that has none of them.
TAG_WEIGHTS = {"nav": 0.02, "footer": 0.02, "aside": 0.05, "header": 0.05, "dialog": 0.05, "menu": 0.05, "form": 0.1}
#: The same for containers whose class, role or id says that they are something else, and what cannot be told from the paths:
#: adverts, notices and comments are prose. Inside an article the mark counts less.
MARKED, MARKED_INSIDE = 0.03, 0.05
MARK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner sidebar cookie cookies consent"
    " notice notices alert popup newsletter subscribe share sharing social comment comments reply replies related recommended"
    " menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar complementary contentinfo".split())
#: The same for paths outside of the ``article`` elements of a page that has any with text.
OUTSIDE = 0.01
_CONTAINERS = frozenset("div section ul ol aside table p span".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre"
    " article section main header footer nav aside form fieldset figure figcaption address details summary hr".split())
#: A start tag that ends an open element of these tags.
_ENDS = {
    **dict.fromkeys(_BLOCK - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot"}, ("p",)),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
_STOPS = {
    "p": frozenset("body div article section main table td th li blockquote nav aside header footer form".split()),
    "li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
    "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"]), "thead": frozenset(["table"]),
    "tbody": frozenset(["table"])}
_MARKS = re.compile(r"[.,;:!?。，、；：！？…]")
_NAME = re.compile(r"[a-z]+")
_ODD_DECLARATION = re.compile(r"<!\[(?:[^>]*\]\]>|[^>]*>)")
#: Weight of a block's own path against its neighbours', the share of the strongest path that a content path has, and the
#: share of links from which on a block between content is none.
OWN, SHARE, MOSTLY_LINKS = 0.75, 0.03, 0.5


@dataclass
class _Block:
    """A block of text: its path and element numbers from the root, what it holds, and what its tags say of it."""

    path: str
    chain: tuple[int, ...]
    tags: tuple[str, ...]
    weight: float
    texts: list[str] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    marks: int = 0

    @property
    def heading(self) -> bool:
        return bool(_HEADINGS.intersection(self.tags))

    @property
    def links(self) -> float:
        return self.linked / self.size


class _Blocks(HTMLParser):
    """The shown blocks of a page that hold more than white space, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, float, bool]] = []
        self.blocks: list[_Block] = []
        self.made = 0
        self.fresh = True

    def _inside(self) -> bool:
        return any(t in ("article", "main") for t, *_ in self.open)

    def _weight(self, tag: str, attrs) -> float:
        weight = 1.0 if tag == "header" and self._inside() else TAG_WEIGHTS.get(tag, 1.0)
        if tag in _CONTAINERS:
            # Inside an article an id is a place to link to.
            names = ("class", "role") if self._inside() else ("class", "role", "id")
            said = " ".join(value for name, value in attrs if name in names and value)
            if MARK_WORDS.intersection(_NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", said).lower())):
                weight *= MARKED_INSIDE if self._inside() else MARKED
        return weight

    def _hidden(self, tag: str, attrs) -> bool:
        return tag in HIDDEN_TAGS or any(
            name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) for name, value in attrs)

    def _end(self, tags: tuple[str, ...]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in tags:
                del self.open[at:]
                break
            if self.open[at][0] in _STOPS.get(tags[0], ()):
                break

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _ENDS:
            self._end(_ENDS[tag])
        if tag in _BLOCK or tag == "br":
            self.fresh = True
        if tag not in _VOID:
            self.made += 1
            hidden = bool(self.open and self.open[-1][3]) or self._hidden(tag, attrs)
            self.open.append((tag, self.made, self._weight(tag, attrs), hidden))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.fresh = True
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][3]:
            return
        size = len("".join(data.split()))
        if self.fresh:
            if not size:
                return
            built = [(t if w == 1.0 else f"{t}!", n, w) for t, n, w, _ in self.open if t in _BLOCK or w != 1.0]
            self.blocks.append(_Block(
                ".".join(t for t, _, _ in built), tuple(n for _, n, _ in built), tuple(t for t, *_ in self.open),
                float(np.prod([w for _, _, w in built]))))
            self.fresh = False
        block = self.blocks[-1]
        block.texts.append(data)
        block.size += size
        block.marks += len(_MARKS.findall(data))
        if any(t == "a" for t, *_ in self.open):
            block.linked += size


def _smoothed(x: np.ndarray) -> np.ndarray:
    """Geometric mean of each value and the mean of its two neighbours; what is small by itself stays small."""
    beside = np.pad(x, 1, mode="edge")
    return x**OWN * ((beside[:-2] + beside[2:]) / 2) ** (1 - OWN)


def content_paths(blocks: list[tuple[str, int, int, int, float]]) -> set[str]:
    """Paths of content among (path, characters, punctuation marks, characters of links, weight of the tags) of blocks in page order."""
    paths = sorted({b[0] for b in blocks})
    number = {p: i for i, p in enumerate(paths)}
    at = np.array([number[b[0]] for b in blocks])
    count = np.bincount(at, minlength=len(paths))

    def per_path(values) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=len(paths)) / count

    length, marks, linked, weight = (per_path([b[i] for b in blocks]) for i in range(1, 5))
    links = linked / length
    length = per_path(_smoothed(length[at]))
    marks = per_path(_smoothed(1 + marks[at]))
    score = length * marks * (1 - links) ** 2 * weight
    return {p for p, s in zip(paths, score, strict=True) if s >= SHARE * score.max() and s > 0}


def _article_of(block: _Block) -> int:
    """Number of the outermost ``article`` around a block, 0 without one."""
    return next((n for n, step in zip(block.chain, block.path.split("."), strict=False) if step.rstrip("!") == "article"), 0)


def _chosen(blocks: list[_Block]) -> list[_Block]:
    """The blocks that make up the article."""
    articles = {_article_of(b) for b in blocks} - {0}
    weights = [b.weight * (OUTSIDE if articles and not _article_of(b) else 1.0) for b in blocks]
    paths = content_paths([(b.path, b.size, b.marks, b.linked, w) for b, w in zip(blocks, weights, strict=True)])
    strong = [i for i, b in enumerate(blocks) if b.path in paths]
    if not strong:
        return []
    usual = max(weights[i] for i in strong)
    fits = [w >= usual / 2 and (b.links < MOSTLY_LINKS or b.heading) for b, w in zip(blocks, weights, strict=True)]
    low, high = strong[0], strong[-1]
    # A title in front, with what stands between it and the text; other headings if they stand right in front.
    first = next((i for i in range(low) if "h1" in blocks[i].tags and fits[i]), low)
    while first == low and low and blocks[low - 1].heading and fits[low - 1]:
        first = low = low - 1
    own = {_article_of(blocks[i]) for i in strong} - {0}
    picked = set(strong)
    for i, block in enumerate(blocks):
        if fits[i] and (first <= i <= high or _article_of(block) in own):
            picked.add(i)
    return [blocks[i] for i in sorted(picked)]


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, white space inside each turned into one space, joined by one space."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(_ODD_DECLARATION.sub("", html))
    parser.close()
    if not parser.blocks:
        return ""
    return " ".join(" ".join("".join(b.texts).split()) for b in _chosen(parser.blocks))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty page and one without an article's text give the empty text. Whole pages are read, however long or
    broken; repeated rows give the same text; page_id and url are passed on, null or not; other columns are ignored
    whatever their names; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(_extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
