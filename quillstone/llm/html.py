"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/"'>]+)""")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}

# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: A start tag ends open elements of these kinds, up to the given border.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}

#: Elements that are never the article's text.
_NOISE_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu title input search audio video".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tooltip".split())
#: Words of class and id names that mark what is not the article.
_NOISE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup overlay modal paywall "
    "sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager skip copyright disclaimer".split()
)
#: Words that say nothing of what an element holds: with these beside it a noise word still marks ("comments-section"),
#: with any other it doesn't inside an article ("related-work", "share-price").
_NEUTRAL_NAMES = frozenset(
    "list box container wrapper wrap section block area bar panel row col column group item items link links button buttons icon icons slot unit zone inner outer content body title heading "
    "label text top bottom left right main site page post posts article articles story stories entry thread form user js is has new all"
    .split()
)
_COMMENT_NAMES = frozenset("comment comments reply replies ad ads advert sponsored related recommended promo".split())
_KEPT_TAGS = frozenset("html body main".split())
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")
#: What an element's own tag says: text, never text, or text only if the article is around it.
_TEXT, _NOISE, _DOUBTFUL = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "items", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: int):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.items: list = []  # texts and nodes, in page order


def _noise(tag: str, attrs: str, inside_article: bool, in_code: bool) -> int:
    if tag in _NOISE_TAGS or (tag == "header" and not inside_article):
        return _NOISE
    if not attrs or not attrs.strip():
        return _TEXT
    names: list[str] = []
    for m in _ATTRIBUTE.finditer(attrs):
        key = (m[1] or m[5]).lower()
        value = unescape(next((g for g in m.groups()[1:4] if g is not None), ""))
        if key in ("class", "id"):
            names.append(_CAMEL.sub("-", value).lower())
        elif key == "role" and value.strip().lower() in _NOISE_ROLES:
            return _NOISE
        elif (key == "hidden" and value.lower() != "false") or (key == "aria-hidden" and value.lower() == "true"):
            return _TEXT if tag in _KEPT_TAGS else _NOISE
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return _TEXT if tag in _KEPT_TAGS else _NOISE
    if tag in _KEPT_TAGS:
        return _TEXT
    split = [set(filter(None, _NAME_PARTS.split(_DIGITS.sub("", name)))) for n in names for name in n.split()]
    if tag == "article":
        return _NOISE if any(_marks(own, _COMMENT_NAMES) for own in split) else _TEXT
    if in_code or tag in ("pre", "code"):  # names there are those of a highlighter
        return _TEXT
    if any(_marks(own, _NOISE_NAMES) for own in split):
        return _NOISE
    if inside_article:
        return _TEXT
    return _DOUBTFUL if any(not own.isdisjoint(_NOISE_NAMES) or "header" in own for own in split) else _TEXT


def _marks(own: set[str], noise: frozenset[str]) -> bool:
    return not own.isdisjoint(noise) and own <= noise | _NEUTRAL_NAMES


def parse(html: str) -> Node:
    """A lenient tree: missing end tags are implied, stray ones are ignored; depth doesn't matter.

    The places of open elements are kept by kind, so that no tag walks the open elements: time is linear in the page.
    """
    root = Node("#root", None, _TEXT)
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a kind, outermost first
    blocks: list[int] = []  # of the open block elements
    at = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in _BLOCK:
                blocks.pop()

    def nearest(kinds: set[str]) -> int:
        return max((places[k][-1] for k in kinds if places[k]), default=0)

    last = html.rfind(">") + 1  # nothing behind it is a tag
    while True:
        m = _TOKEN.search(html, at, last) if at < last else None
        text = html[at : m.start()] if m else html[at:]
        if text:
            stack[-1].items.append(text)
        if not m:
            return root
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                return root  # a comment without an end
            if m["cdata"]:
                stack[-1].items.append(m["cdata"])
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "br" or tag == "p" and not places["p"]:
                stack[-1].items.append(Node("br", stack[-1], _TEXT))
            elif places[tag]:
                pop_to(places[tag][-1])
            continue
        if tag in _CLOSES_P and places["p"] and blocks[-1] == places["p"][-1]:
            pop_to(blocks[-1])  # an open p ends with what it holds, but only if it is the nearest block
        if tag in _ENDS:
            kinds, border = _ENDS[tag]
            edge = nearest(border)
            found = min((p[i] for p in map(places.__getitem__, kinds) if (i := bisect_right(p, edge)) < len(p)), default=0)
            if found:
                pop_to(found)
        if tag in ("html", "body", "head") and places[tag]:
            continue
        attrs = m["attrs"]
        inside = bool(places["article"] or places["main"])
        node = Node(tag, stack[-1], _noise(tag, attrs, inside, bool(places["pre"] or places["code"])))
        stack[-1].items.append(node)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            stop = end.start() if end else len(html)
            if tag not in ("script", "style"):
                node.items.append(html[at:stop])
            close = html.find(">", stop)
            at = close + 1 if end and close >= 0 else len(html)
        elif tag not in _VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
            places[tag].append(len(stack))
            if tag in _BLOCK:
                blocks.append(len(stack))
            stack.append(node)


def _walk(root: Node) -> list[Node]:
    """Nodes that are not noise, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.items) if type(x) is Node and not x.noise]
    return order


def _score(order: list[Node]) -> None:
    """Composite text density of each node, and the sum of its children's."""
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.items:
            if type(x) is str:
                node.chars += len("".join(x.split()))
            elif not x.noise:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = order[0]
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if not c:
            node.density = 0.0
            continue
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        node.density = c / t * max(math.log(c / max(lc, 1) * (t / lt)), 0.0) / base if lc else c / t * math.log(max(c * t, 2)) / base
    for node in order:
        node.total = sum(x.density for x in node.items if type(x) is Node and not x.noise)
        if any(type(x) is str and x.strip() for x in node.items):
            node.total = max(node.total, node.density)


def _text(nodes: list[Node | str], doubtful: bool = False) -> str:
    """Blocks of the nodes in page order, without noise; with what is doubtful inside them only if asked for."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        own = " ".join(unescape("".join(run)).split())
        if own:
            blocks.append(own)
        run.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if type(x) is str:
                run.append(x)
            elif x is None:
                flush()
            elif not x.noise or x is top or (doubtful and x.noise == _DOUBTFUL):
                if x.tag in _BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(x.items)
    flush()
    return " ".join(blocks)


def extract(html: str | None) -> str:
    """Main text of a page; empty for null, empty and textless pages."""
    if not html:
        return ""
    order = _walk(parse(html))
    _score(order)
    body = next((n for n in order if n.tag == "body"), order[0])
    inside = order[order.index(body) :] if body is not order[0] else order
    best = max(inside, key=lambda n: n.total)
    if not best.chars:
        return ""
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    articles = [n for n in path if n.tag in ("article", "main")]
    if articles:
        whole = articles[-1]  # the outermost: what lies around and beside an inner one is text too
        return _text([x for x in whole.parent.items if x is whole or (whole.tag == "article" and type(x) is Node and x.tag == "article" and _like(x))])
    if len(path) == 1:
        # the body itself: of several articles in it, those that are mostly links only point to others
        several = any(type(x) is Node and x.tag == "article" and x.chars and _like(x) for x in best.items)
        return _text([x for x in best.items if not (type(x) is Node and (x.noise or (several and x.tag == "article" and not _like(x))))])
    # an article may be split over siblings; further from it they must be as dense as the path from the body, and long
    threshold = min(n.density for n in path if n.chars)
    parts: list[Node | str] = [best]
    for below, node in zip(path, path[1:], strict=False):
        place = next(i for i, x in enumerate(node.items) if x is below)
        part = [x is not below and (_like(x) if below is best else _dense(x, below.tag, threshold, best.chars)) for x in node.items]
        parts = [x for x, own in zip(node.items[:place], part, strict=False) if own] + parts + [x for x, own in zip(node.items[place:], part[place:], strict=True) if own]
    return _text(parts, doubtful=True)


def _like(x: Node | str) -> bool:
    """Whether a neighbour of the article is part of it: anything that is not mostly links."""
    return bool(x.strip()) if type(x) is str else not x.noise and x.link_chars * 3 <= x.chars


def _dense(x: Node | str, tag: str, threshold: float, chars: int) -> bool:
    if type(x) is str or not _like(x):
        return False
    return x.tag == "h1" or (x.tag == tag and x.density >= threshold and x.chars * 4 >= chars)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        for lo in range(0, len(column), 256):
            part = column.slice(lo, 256)
            yield pa.record_batch([batch.column(0).slice(lo, 256), pa.array([extract(x) for x in part.to_pylist()], pa.string())], ["id", "text"])


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of each row of pages (html and the kept columns; others are ignored): the kept columns and text.

    Link-adjusted characters per tag (composite text density) are computed for every node that is not a menu, form,
    script, advert, notice or the like; the node whose children's densities sum highest is the article, up to the
    outermost article or main element around it. Without such an element its neighbours are parts of it unless they are
    mostly links; further out, neighbours of the same kind that are as dense as the path from the body and a quarter as
    long, and the first heading. Names mark noise by all their words, outside of the article by one.

    Null, empty and textless pages have the empty text. Repeated rows get a row each. An empty table gives no rows.
    """
    fields = ", ".join(f"{c}: {t}" for c, t in pages.select(*keep).dtypes)
    out = pages.select(F.struct(*keep).alias("id"), "html").mapInArrow(_batches, f"id struct<{fields}>, text string")
    return out.select("id.*", "text")
