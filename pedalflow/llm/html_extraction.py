"""Main text of web pages by tag-path ratios.

A page is read once into blocks: the text between two block-level tags, with the path of block-level elements from the
root to it. For each path the text outside links and its punctuation are summed over the page and divided by the number
of its blocks; both ratios are laid along the page, smoothed with a Gaussian, multiplied, and cut at a share of their
standard deviation. What is selected fixes the content element, the deepest one that holds all of it; headings and short
paragraphs in it belong to the text, linked or not; several blocks or links in a row without a word between them do not.
Elements that a page itself marks as menu, header, footer,
sidebar, notice, advert, form or reader comments are not part of it. Names of headings, paragraphs and list items mark
nothing, and words with other meanings (``related``, ``search``) only as a whole name outside an article. A mark on an
element that holds at least half of the text outside links, and an article, a main element or a first heading of its own,
is the name of a layout (``layout-sidebar``, a form around the page) and does not count.

Time and memory grow in proportion to the page, however deep it is nested and whatever it leaves unclosed.

Blocks are decoded, have their white space turned into single blanks and are joined by newlines in page order.

Defined results: null or empty html, and a page without text outside such elements, give an empty text; broken nesting
is repaired as browsers do in the simple cases (unclosed paragraphs, list items and cells); a page that ends early is
used as far as it goes; rows that repeat give equal texts; an empty table gives an empty table. Input columns named
like a result are replaced by it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pedalflow.llm.storage import small_batches

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre section select summary table"
    " tbody td tfoot th thead title tr ul".split()
)
HIDDEN = set("head title script style noscript template iframe svg math canvas object video audio map applet noframes".split())
RAW = set("script style textarea title xmp noscript iframe noframes".split())
ASIDE = set("nav footer aside form menu dialog button select textarea fieldset".split())
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = set("ul ol dl table menu select body html".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words in class names and ids, and roles, that mark what is not content.
MARKS = set(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist"
    " consent cookie cookies disqus feedback footer login masthead menu menubar modal"
    " nav navbar navigation newsletter notification pager pagination paywall popup promo promoted promotion"
    " recommended replies reply respond share sharing sidebar sidenav signup skip sponsor sponsored"
    " subscribe subscription tagcloud teaser toolbar topbar widget widgets".split()
)
# Words that mark as the whole of a name only, and never inside an article.
AMBIGUOUS = set("copyright disclaimer discussion header meta notice notices related search social".split())
NAMED_BY_TEXT = {"p", "li", *HEADINGS}  # their classes and ids come from what they say
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_CDATA = r"<!\[CDATA\[(.*?)\]\]>"
_MARKUP = r"<!--.*?(?:-->|\Z)|" + _CDATA + r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
_TAG = re.compile(_MARKUP, re.S)
_TAG_UNCLOSED = re.compile(_MARKUP.replace(_CDATA, "(?!)()"), re.S)  # behind the last "]]>" no CDATA section can end
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[^\w\s]")
_WORD = re.compile(r"\w")


@dataclass(frozen=True)
class Params:
    """Production parameters: width of the smoothing in blocks, share of the standard deviation that cuts, and the
    share of a block's text in links from which on it does not choose the content element."""

    sigma: float = 1.0
    cut: float = 0.5
    links: float = 0.5


@dataclass
class Element:
    """``mark`` is the innermost marked element around it, itself included; ``first`` and ``last`` number its subtree."""

    tag: str
    parent: Element | None
    path: int
    hidden: bool
    mark: Element | None = None
    depth: int = 0
    in_article: bool = False
    first: int = 0
    last: int = 0
    marked: bool = False
    mass: int = 0
    holds: bool = False
    dropped: bool = False


@dataclass
class Block:
    element: Element
    text: str
    linked: int = 0
    punctuation: int = 0
    links: int = 0
    only_links: bool = False


def _invisible(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


def _marked(tag: str, attributes: dict[str, str], within: bool) -> bool:
    """Whether an element says itself that it is no content; ``within`` an article its names say less."""
    if attributes.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "main") or tag in NAMED_BY_TEXT:
        return False
    classes, ids = attributes.get("class", "").lower().split(), attributes.get("id", "").lower().split()
    if tag == "section":  # its id is that of its heading, unless it is the bare word
        ids = [] if within else [x for x in ids if x in MARKS]
    elif any(x in AMBIGUOUS for x in ids) and not within:
        return True
    if any(x in AMBIGUOUS for x in classes) and not within:
        return True
    for name in [*classes, *ids]:
        words = re.split(r"[^a-z0-9]+", name)
        if words[0] not in ("has", "with", "no", "without") and any(w in MARKS for w in words):
            return True
    return False


def _settle(elements: list[Element], blocks: list[Block]) -> None:
    """Number the subtrees and decide which marks count: those of elements that are no layout around the content."""
    for b in blocks:
        if b.element.mark is not None:
            b.element.mark.mass += len(b.text) - b.linked
    total = sum(len(b.text) - b.linked for b in blocks)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.last = max(e.parent.last, e.last)
        outer = e.parent.mark if e.parent is not None else None
        if e.marked:
            e.dropped = not (e.holds and 2 * e.mass >= total)
            if outer is not None:
                outer.mass += e.mass
                outer.holds = outer.holds or not e.dropped
    for e in elements:
        if e.marked and e.parent is not None and e.parent.mark is not None:
            e.dropped = e.dropped or e.parent.mark.dropped


def blocks_of(page: str) -> tuple[list[Block], Element]:
    """All blocks with text that lie outside marked and hidden elements, in page order, and the root of their elements."""
    root = Element("#", None, 0, False)
    elements, paths, open_tags = [root], {}, Counter()
    last_cdata = page.rfind("]]>")
    current, out, pieces, linked, links, plain = root, [], [], 0, 0, False
    link: Element | None = None
    at = 0

    def flush() -> None:
        nonlocal linked, links, plain
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not current.hidden:
                out.append(Block(current, text, linked, len(_PUNCTUATION.findall(text)), links, linked > 0 and not plain))
            pieces.clear()
        linked, links, plain = 0, int(link is not None), False

    def add(text: str) -> None:
        nonlocal linked, plain
        if text and not current.hidden:
            text = html.unescape(text)
            pieces.append(text)
            if link is not None:
                linked += len(" ".join(text.split()))
            else:
                plain = plain or _WORD.search(text) is not None

    def close_to(element: Element) -> None:
        nonlocal current, link
        flush()
        while current is not element:
            open_tags[current.tag] -= 1
            current = current.parent
        if link is not None and link.depth > element.depth:
            link = None

    def nearest(tags: set[str], barrier: set[str]) -> Element | None:
        if not any(open_tags[t] for t in tags):
            return None
        e = current
        while e is not root and e.tag not in barrier:
            if e.tag in tags:
                return e
            e = e.parent
        return None

    size = len(page)
    while at < size:
        found = (_TAG if at <= last_cdata else _TAG_UNCLOSED).search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found[1] is not None:
            add(html.escape(found[1]))
            continue
        closing, tag, rest = (found[2], found[3], found[4]) if found[3] else (found[5], found[6], found[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link = None if closing else current
            links += not closing
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if closing:
            if tag in BLOCKS or tag in HIDDEN or tag in ASIDE:
                e = nearest({tag}, {"#"})
                if e is not None:
                    close_to(e.parent)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if not (tag in BLOCKS or tag in HIDDEN or tag in ASIDE):
            attributes = {}
            continue
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
        if tag in BLOCKS:
            e = nearest(CLOSED_BY_BLOCK, BARRIER | {"td", "th", "li", "button"})
            if e is not None:
                close_to(e.parent)
        if tag in CLOSED_BY_SAME:
            e = nearest(CLOSED_BY_SAME[tag], BARRIER)
            while e is not None:
                close_to(e.parent)
                e = nearest(CLOSED_BY_SAME[tag], BARRIER) if tag == "tr" else None
        flush()
        within = current.in_article or tag in ("article", "main")
        if rest.rstrip().endswith("/") and tag in HIDDEN:
            continue
        hidden = current.hidden or tag in HIDDEN or _invisible(attributes)
        marked = tag in ASIDE or (tag == "header" and not within) or _marked(tag, attributes, within)
        classes = ".".join(attributes.get("class", "").split()[:1])
        path = paths.setdefault((current.path, tag, classes), len(paths) + 1)
        element = Element(tag, current, path, hidden, current.mark, current.depth + 1, within, len(elements), len(elements), marked)
        if marked:
            element.mark = element
        elif tag in ("article", "main", "h1") and element.mark is not None and not hidden:
            element.mark.holds = True
        elements.append(element)
        open_tags[tag] += 1
        current = element
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.start() if end else size
    flush()
    _settle(elements, out)
    return [b for b in out if b.element.mark is None or not b.element.mark.dropped], root


def _smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, "edge"), kernel / kernel.sum(), "valid")


def main_text(page: str | None, params: Params = Params()) -> str:
    """The main text of one page."""
    blocks, root = blocks_of(page) if page else ([], None)
    if not blocks:
        return ""
    totals: dict[int, list[float]] = {}
    for b in blocks:
        t = totals.setdefault(b.element.path, [0, 0, 0])
        t[0] += max(0, len(b.text) - b.linked)
        t[1] += b.punctuation if b.linked < len(b.text) else 0
        t[2] += 1
    length = np.array([totals[b.element.path][0] / totals[b.element.path][2] for b in blocks])
    signs = np.array([(totals[b.element.path][1] + 1) / totals[b.element.path][2] for b in blocks])
    score = _smoothed(length, params.sigma) * _smoothed(signs, params.sigma)
    prose = np.array([b.linked < params.links * len(b.text) for b in blocks])
    score = np.where(prose, score, 0)
    chosen = (score > 0) & (score >= min(params.cut * score.std(), score.max()))
    if not chosen.any():
        return ""
    places = [blocks[i].element.first for i in np.flatnonzero(chosen)]
    holder = blocks[int(np.flatnonzero(chosen)[0])].element
    while holder is not root and not holder.first <= min(places) <= max(places) <= holder.last:
        holder = holder.parent
    if holder.tag in ("p", "li", "td", "th", "pre", *HEADINGS) and holder.parent is not None:
        holder = holder.parent
    first, last = np.flatnonzero(chosen)[[0, -1]]
    loose = holder.tag in ("#", "html", "body")  # nothing narrower holds the content: stay between its ends
    listed = [b.only_links and b.element.tag not in HEADINGS for b in blocks]
    kept = []
    for i, b in enumerate(blocks):
        several = listed[i] and (b.links > 1 or (i > 0 and listed[i - 1]) or (i + 1 < len(blocks) and listed[i + 1]))
        inside = holder.first <= b.element.first <= holder.last and not several
        if loose:
            inside = inside and (chosen[i] or first <= i <= last or (b.element.tag in HEADINGS and i < first))
        if inside:
            kept.append(b.text)
    return "\n".join(kept)


RESULTS = ["text", "n_chars"]


def extracted(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and its number of code points ``n_chars``."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c.lower() not in ("html", *RESULTS)]
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), params) for page in batch.column("html")]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=schema.names)

    return pages.select(*kept, "html").mapInArrow(extract, schema)
