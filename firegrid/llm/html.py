"""Main text of web pages by two-pass block rules.

First pass: a page is cut into blocks at block-level tags; each block is good, bad or ambiguous from its
length, its share of stop words and its share of linked characters. Blocks in parts that are by their
name no article (navigation, footers, forms, advertisements, comments) are bad, whatever their text. Names are
whole class tokens, and a wrapper around the page's only articles is not bad for its class.
Second pass: ambiguous blocks, mostly short ones, take the label of the nearest decided block of the
same container; where the nearest ones differ, the good one counts, and where none is decided, blocks
of an article are good and others bad. On a page with hardly any of the stop words (another language, code)
the long blocks are good, as their words say nothing.

Nulls: a null html is an empty page; null ids and urls are kept. An empty page has empty text. Markup
that is cut off or never closed ends with the page. Repeated rows are worked on each. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import fields

# Frequent function words of the languages worked on; a parameter of ``main_text``.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have "
    "an had they you were their one all we can her has there been if more when will would who so no "
    "der die das und ist von zu den mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et en un une du que qui dans pour par sur est au plus pas ce il ne se avec sont elle son "
    "el los las y del que en un una por con para es se no su al lo como más pero sus le ha o este sí".split()
)

_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption dialog menu".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset(
    "nav header footer aside form script style noscript template svg iframe button select textarea object canvas head title "
    "menu dialog audio video label option".split()
)
_RAW = re.compile(r"<(script|style|textarea|title|noscript|template|iframe)\b", re.I)
_LISTS = r"comments?|reply|replies|related|recommend\w*"
_NAME = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav(?:s|bar|igation)?|menu|sidebar|side|widget|footer|header|masthead"
    r"|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|social"
    rf"|breadcrumbs?|pagination|pager|disclaimer|copyright|toolbar|skip|{_LISTS})"
)
# What may stand beside names in a class; others (has-sidebar, no-ads, side-by-side) say something else.
_BESIDE = r"(?:site|page|main|top|bottom|left|right|list|box|block|bar|slot|unit|wrapper|container|inner|\d+)"
_NAMES = re.compile(rf"(?<!\S)(?:{_BESIDE}[_-]+)*{_NAME}(?:[_-]+(?:{_NAME}|{_BESIDE}))*(?!\S)", re.I)
_OTHERS = re.compile(rf"(?:^|[\s_-])(?:{_LISTS})(?:$|[\s_-])", re.I)
_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*|[^<>]*)/?>?""", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_CLOSES_P = _BLOCK - {"body", "html"}


@dataclass
class Block:
    text: str
    linked: int
    dropped: bool
    container: int
    article: bool
    wrappers: tuple[int, ...] = ()
    label: str = ""


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with linked characters and the container they stand in."""
    found: list[Block] = []
    # tag, dropped, in an article, container, open elements that are no article by their class
    stack: list[tuple[str, bool, bool, int, tuple[int, ...]]] = [("", False, False, 0, ())]
    around: dict[int, tuple[int, ...]] = {}  # those of them around a container
    parts: list[str] = []
    linked, in_link, containers, elements = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", references.unescape("".join(parts))).strip()
        if text:
            _, dropped, article, container, wrappers = stack[-1]
            found.append(Block(text, min(linked, len(text)), dropped, container, article, wrappers))
        parts.clear()
        linked = 0

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if tag not in ("article", "main", "body", "html") and stack[k][0] in ("article", "main"):
                return  # a stray end tag does not leave the article

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    at = 0
    while at < len(page):
        low = page.find("<", at)
        if low < 0:
            add(page[at:])
            break
        if low > at:
            add(page[at:low])
        mark = _MARK.match(page, low)
        if mark is None:
            add("<")
            at = low + 1
            continue
        at = mark.end()
        if mark.group(2) is None:
            continue
        closing, tag, rest = mark.group(1), mark.group(2).lower(), mark.group(3) or ""
        if not closing and _RAW.match(page, low):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if not (tag == "title" and end is None):
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        breaks = tag in _BLOCK or tag in _DROPPED
        if breaks:
            flush()
            in_link = False
            if not closing and tag in _CLOSES_P and stack[-1][0] == "p":
                stack.pop()
        if closing:
            if breaks or len(stack) > 1 and stack[-1][0] == tag:
                close(tag)
            continue
        if tag in _VOID or rest.endswith("/"):
            continue
        if breaks:
            _, dropped, article, container, wrappers = stack[-1]
            names = " ".join("".join(x) for x in _ATTRIBUTE.findall(rest)) if rest else ""
            dropped = dropped or tag in _DROPPED
            if tag not in ("body", "html", "article", "main") and names and _NAMES.search(names):
                # What is inside an article, or lists other articles, cannot be a wrapper of the page's own.
                if article or _OTHERS.search(names):
                    dropped = True
                else:
                    elements += 1
                    wrappers = (*wrappers, elements)
            if tag in ("article", "main"):
                containers += 1
                article, container = True, containers
                around[container] = wrappers
            stack.append((tag, dropped, article, container, wrappers))
    flush()
    _judge_wrappers(found, around)
    return found


def _judge_wrappers(found: list[Block], around: dict[int, tuple[int, ...]]) -> None:
    """Drop what stands in wrappers, but for those around the main article: the longest of the wrapped articles, if no
    article stands outside and it is longer than all text outside."""
    outside, held, free_article = 0, {}, False
    for block in found:
        if block.dropped:
            continue
        if not block.wrappers:
            outside += len(block.text)
            free_article = free_article or block.article
        elif block.article:
            own = around[block.container]
            held[own] = held.get(own, 0) + len(block.text)
    main = max(held, key=held.get, default=())
    kept = set(main) if main and not free_article and held[main] > outside else set()
    for block in found:
        block.dropped = block.dropped or not kept.issuperset(block.wrappers)


def first_pass(block: Block, stop_words=STOP_WORDS, short=70, long=200, low=0.1, high=0.25, links=0.3) -> str:
    """good, bad or ambiguous, from the block alone."""
    if block.dropped:
        return "bad"
    length = len(block.text)
    if block.linked > links * length:
        return "bad"
    if length < short:
        return "ambiguous"
    stops, words = _stops(block, stop_words)
    density = stops / words
    if density >= high:
        return "good"
    if density >= low:
        return "good" if length >= long or block.article else "ambiguous"
    return "ambiguous"


def _stops(block: Block, stop_words) -> tuple[int, int]:
    """Stop words and words of a block."""
    words = block.text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in stop_words for w in words), len(words)


def without_stop_words(found: list[Block], stop_words=STOP_WORDS, short=70, low=0.1, **_) -> None:
    """Make the long ambiguous blocks good where none is and, over all of them, stop words are rare."""
    own = [b for b in found if b.label == "ambiguous" and len(b.text) >= short]
    if own and not any(b.label == "good" for b in found):
        stops, words = map(sum, zip(*(_stops(b, stop_words) for b in own)))
        if stops < low * words:
            for block in own:
                block.label = "good"


def second_pass(found: list[Block]) -> None:
    """Give ambiguous blocks the label of the nearest decided ones; dropped parts decide nothing."""
    by_container: dict[int, list[Block]] = {}
    for block in found:
        if not block.dropped:
            by_container.setdefault(block.container, []).append(block)
    for own in by_container.values():
        before: list[tuple[int, str]] = []
        last = (len(own) + 1, "")
        for block in own:
            last = (0, block.label) if block.label != "ambiguous" else (last[0] + 1, last[1])
            before.append(last)
        last = (len(own) + 1, "")
        for i in range(len(own) - 1, -1, -1):
            block = own[i]
            if block.label != "ambiguous":
                last = (0, block.label)
                continue
            last = (last[0] + 1, last[1])
            near = [x for x in (before[i], last) if x[1]]
            nearest = min((n for n, _ in near), default=0)
            labels = {label for n, label in near if n == nearest}
            block.label = "good" if "good" in labels or not labels and block.article else "bad"


def extract(page: str, **rules) -> str:
    """The main text: good blocks in page order, joined by two line feeds."""
    found = blocks(page)
    for block in found:
        block.label = first_pass(block, **rules)
    without_stop_words(found, **rules)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def main_text(pages: DataFrame, **rules) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; ``rules`` are those of ``first_pass``."""
    schema = fields(
        ("page_id", pages.schema["page_id"].dataType), ("url", pages.schema["url"].dataType), ("text", "string"), ("n_chars", "long")
    )

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [extract(page or "", **rules) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                names=schema.names,
            )

    return pages.select("page_id", "url", "html").mapInArrow(texts, schema)
