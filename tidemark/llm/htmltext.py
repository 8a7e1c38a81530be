"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks at block-level tags. Each block has its word count
and link density, those of its neighbours, and whether it lies in an article,
in an element that names itself navigation, header, footer, sidebar, form and
the like, or in one whose class or id hints at it. A decision tree, grown from
the small labelled table below, tells the blocks of the article.

Defined cases: a null or empty page has an empty text; unclosed, stray and
wrongly nested tags are tolerated; an article or main element ends what was
left open before it; repeated rows get equal results.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import chunks

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)",
    re.S,
)
#: Elements whose content isn't text, and those that hold no element (fixed values of HTML).
RAW = frozenset("script style noscript template iframe object svg math head title textarea select option button canvas noframes".split())
TO_END_TAG = frozenset("script style title textarea noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr input".split())
AWAY = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|widget\w*|footer|masthead|header|topbar|toolbar"
    r"|comment\w*|respond|discussion|disqus\w*|reply|replies|share\w*|social\w*|related\w*|recommended|newsletter|subscribe|subscription|signup|login|popup\w*|modal|overlay|pagination|pager|search\w*|skip\w*)(?:$|[\s_-])",
    re.I,
)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "away", "hinted")
#: Labelled blocks, in the order of FEATURES, and 1 for main text. Made by hand from common page layouts.
LABELLED = (
    # paragraphs and headings of an article
    ((60, 0.00, 45, 0.0, 70, 0.0, 1, 0, 0), 1), ((25, 0.04, 60, 0.0, 12, 0.0, 1, 0, 0), 1), ((8, 0.00, 3, 1.0, 60, 0.0, 1, 0, 0), 1), ((1, 0.00, 40, 0.0, 50, 0.0, 1, 0, 0), 1),
    ((1, 0.00, 1, 0.0, 1, 0.0, 1, 0, 0), 1), ((2, 0.00, 0, 0.0, 0, 0.0, 1, 0, 0), 1), ((120, 0.10, 8, 0.0, 4, 1.0, 1, 0, 0), 1), ((12, 0.30, 70, 0.1, 30, 0.0, 1, 0, 0), 1),
    ((6, 0.00, 90, 0.0, 80, 0.0, 1, 0, 0), 1), ((4, 0.25, 20, 0.0, 25, 0.0, 1, 0, 0), 1), ((5, 1.00, 40, 0.0, 60, 0.0, 1, 0, 0), 1), ((3, 0.00, 12, 1.0, 9, 1.0, 1, 0, 0), 1),
    # lists of links inside an article
    ((2, 1.00, 2, 1.0, 2, 1.0, 1, 0, 0), 0), ((3, 1.00, 4, 1.0, 3, 1.0, 1, 0, 0), 0), ((1, 1.00, 1, 1.0, 1, 1.0, 1, 0, 0), 0),
    # parts that name themselves, wherever they are
    ((1, 1.00, 1, 1.0, 1, 1.0, 0, 1, 0), 0), ((4, 0.00, 1, 1.0, 30, 0.0, 0, 1, 0), 0), ((40, 0.05, 50, 0.0, 0, 0.0, 0, 1, 0), 0), ((25, 0.00, 60, 0.0, 70, 0.0, 1, 1, 0), 0),
    ((3, 0.00, 30, 0.0, 80, 0.0, 1, 1, 0), 0), ((70, 0.00, 90, 0.0, 0, 0.0, 0, 1, 0), 0), ((9, 0.40, 0, 0.0, 7, 0.0, 0, 1, 1), 0), ((15, 0.00, 15, 0.0, 15, 0.0, 0, 1, 0), 0),
    ((12, 0.00, 1, 1.0, 8, 0.0, 0, 0, 1), 0), ((60, 0.00, 30, 0.0, 40, 0.0, 0, 0, 1), 0), ((35, 0.00, 60, 0.0, 20, 0.0, 1, 0, 1), 0), ((2, 1.00, 2, 1.0, 70, 0.0, 1, 0, 1), 0),
    ((5, 0.00, 40, 0.0, 0, 0.0, 0, 0, 1), 0), ((1, 0.00, 60, 0.0, 50, 0.0, 1, 0, 1), 0),
    # pages without an article element
    ((50, 0.02, 40, 0.0, 60, 0.0, 0, 0, 0), 1), ((30, 0.00, 6, 0.0, 45, 0.0, 0, 0, 0), 1), ((9, 0.00, 50, 0.0, 60, 0.0, 0, 0, 0), 1), ((7, 0.00, 3, 0.0, 55, 0.0, 0, 0, 0), 1),
    ((80, 0.20, 2, 1.0, 3, 1.0, 0, 0, 0), 1), ((18, 0.00, 20, 0.0, 25, 0.0, 0, 0, 0), 1), ((14, 0.00, 35, 0.0, 2, 0.0, 0, 0, 0), 1), ((20, 0.10, 0, 0.0, 0, 0.0, 0, 0, 0), 1),
    ((2, 1.00, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((3, 0.00, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((12, 0.90, 10, 0.8, 14, 0.9, 0, 0, 0), 0), ((30, 0.70, 3, 1.0, 3, 1.0, 0, 0, 0), 0),
    ((4, 0.00, 1, 1.0, 3, 0.5, 0, 0, 0), 0), ((5, 0.00, 3, 0.0, 4, 0.0, 0, 0, 0), 0), ((1, 0.00, 1, 0.0, 2, 0.0, 0, 0, 0), 0), ((25, 0.60, 60, 0.0, 2, 1.0, 0, 0, 0), 0),
)


@dataclass
class Node:
    feature: int
    at: float
    low: Node | float
    high: Node | float


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node | float:
    """A classification tree by Gini impurity; a leaf is the share of label 1."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return float(y.mean())
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for at in (values[1:] + values[:-1]) / 2:
            side = x[:, j] <= at
            impurity = sum(s.sum() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (side, ~side))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, j, float(at), side)
    if best is None:
        return float(y.mean())
    _, j, at, side = best
    return Node(j, at, grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1))


def decide(tree: Node | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Node):
        return np.full(len(x), tree)
    side = x[:, tree.feature] <= tree.at
    out = np.empty(len(x))
    out[side], out[~side] = decide(tree.low, x[side]), decide(tree.high, x[~side])
    return out


def labelled_tree() -> Node | float:
    return grow(np.array([x for x, _ in LABELLED], np.float64), np.array([y for _, y in LABELLED], np.float64))


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    in_article: bool
    away: bool
    hinted: bool


def named(attributes: str) -> bool:
    if not attributes or ("=" not in attributes and "hidden" not in attributes.lower()):
        return False
    return bool(HIDDEN.search(attributes)) or any(HINT.search(a or b or c) for a, b, c in NAMED.findall(attributes))


def tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """The text before each tag, then the tag's name in lower case ('' for comments and the end), '/' if it closes, and its attributes. Raw text is skipped."""
    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            yield page[at:], "", "", ""
            return
        text = page[at : m.start()]
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            yield text, "", "", ""
            continue
        tag = tag.lower()
        close = m["close"] or m["close2"] or ""
        yield text, tag, close, m["attributes"] or m["attributes2"] or ""
        if tag in TO_END_TAG and not close:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = end.start() if end else len(page)
            if not end:
                yield "", tag, "/", ""
                continue


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag; in an article, away, hinted, raw
    state = (False, False, False, False)
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, text.count(" ") + 1, len(entities.unescape(" ".join(linked)).split()), *state[:3]))
            parts.clear()
            linked.clear()

    for text, tag, close, attributes in tags(page):
        if text and not state[3]:
            parts.append(text)
            if links:
                linked.append(text)
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if close else 1
        if tag in INLINE and tag not in RAW:
            if not (named(attributes) and tag == "span"):
                continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in RAW:
            flush()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    state = stack[-1][1:] if stack else (False, False, False, False)
                    break
            if tag not in INLINE:
                links = 0
            continue
        if tag in ("p", "li", "td", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
            stack.pop()
            state = stack[-1][1:] if stack else (False, False, False, False)
        if tag == "body":
            stack.clear()
            state = (False, False, False, False)
        article, away, hinted, raw = state
        if tag in ARTICLE and not hinted and not article:
            away = raw = False
        hint = tag not in ("html", "body") and tag not in ARTICLE and named(attributes)
        state = (article or tag in ARTICLE, away or tag in AWAY, hinted or hint, raw or tag in RAW)
        stack.append((tag, *state))
    flush()
    return out


def extract(pages: list[str], tree: Node | float) -> list[str]:
    found = [blocks(p) for p in pages]
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = [b for page in found for b in page]
    if not flat:
        return [""] * len(pages)
    words = np.array([b.words for b in flat], np.float64)
    links = np.array([min(1.0, b.link_words / b.words) for b in flat])
    owner = np.repeat(np.arange(len(n)), n)
    same = owner[1:] == owner[:-1]
    x = np.zeros((len(flat), len(FEATURES)))
    x[:, 0], x[:, 1] = words, links
    for j, v in ((2, words), (3, links)):
        x[1:, j] = np.where(same, v[:-1], 0)
        x[:-1, j + 2] = np.where(same, v[1:], 0)
    x[:, 6:] = [(b.in_article, b.away, b.hinted) for b in flat]
    keep = decide(tree, x) >= 0.5
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(keep):
        out[owner[i]].append(flat[i].text)
    return [" ".join(t) for t in out]


def extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = labelled_tree()
    for batch in chunks(batches, "html"):
        texts = extract([h or "" for h in batch.column("html").to_pylist()], tree)
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html). Narrow."""
    return pages.select("page_id", "url", "html").mapInArrow(extractor, "page_id long, url string, text string, n_chars long")
