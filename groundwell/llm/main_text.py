"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks: runs of text between the borders of block elements. Every block is a
node. The source stands for content, the sink for boilerplate; the capacity to the one it is cut off
from is what a classifier says this would cost. Smoothness edges join blocks that follow one another
and blocks that follow one another inside the same element; the more element borders lie between
them, the less an edge holds. The minimum cut is the cheapest labelling, found exactly: blocks whose
own cost exceeds all their edges are settled first and their edges become costs of their
neighbours, what is left is cut by maximum flow.

The classifier is a naive Bayes model over the look of blocks (element, length, share of linked
characters, sentence marks, words of class names, place), trained on blocks that the markup of the
pages itself labels: inside article or main, or inside elements made for something else. SAMPLE
pages, the least by a hash of their ids, are its training rows. What markup says of a block itself
adds a fixed cost.

Defined cases: a null page counts as empty; a page without content gives an empty text; comments, scripts
and styles without end reach to the end of the page, other elements hide no text by lacking one; hidden elements
are no content; null ids and repeated rows are worked on one by one; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm import words as w
from groundwell.llm.tables import prefixed

#: Pages that the classifier is trained on.
SAMPLE = 4_000
#: Cost units: what markup says of a block, an edge without borders between, a model's log odds at most.
MARKUP, SMOOTH, MODEL = 6.0, 1.5, 4.0
UNIT = 1000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands inside is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title head".split())
#: Their content has no tags of its own.
OPAQUE = frozenset("script style textarea title iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby "
    "s samp small source span strike strong sub sup time tt u var wbr br".split()
)
#: Opening one of the left closes an open one of the right, up to the nearest of CLOSES_AT.
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
        "menu nav ol p pre section table ul".split(), {"p"},
    ),
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "tbody": {"thead", "tbody", "tr", "td", "th", "p"}, "tfoot": {"tbody", "tr", "td", "th", "p"},
}
CLOSES_AT = frozenset("ul ol dl table div section article aside nav main header footer form body html button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements and roles for something else than the main text, and class or id words that say so.
ASIDE_TAGS = frozenset("nav aside footer header form menu dialog button".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead comment comments disqus replies cookie cookies consent gdpr notice notices banner popup modal overlay "
    "share sharing social related recommended newsletter subscribe signup login search pager pagination toolbar widget widgets skip".split()
)
#: Of these an article element inside does not lead back to content.
CLOSED_WORDS = frozenset("comment comments disqus replies related recommended sidebar".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_MARK = re.compile(r"[.!?…。！？:;,\"»”)]$")


@dataclass(slots=True)
class Element:
    tag: str
    kind: int  # 1: content, -1: something else, 0: not said
    closed: bool  # nothing inside is content again
    number: int
    names: tuple[str, ...]


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    kind: int
    parent: int
    names: tuple[str, ...]
    linked: int
    borders: int  # element borders since the block before


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _element(tag: str, raw: str, above: Element, number: int) -> Element:
    found = _attributes(raw) if raw.strip() else {}
    listed = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    # "has-sidebar" says that there is one elsewhere.
    names = tuple(x for name in listed if not name.startswith(("has-", "with-", "no-", "without-")) for x in _WORDS.findall(name))
    said = tag not in ("html", "body") and not ASIDE_WORDS.isdisjoint(names)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    aside = said or hidden or tag in ASIDE_TAGS or found.get("role") in ASIDE_ROLES
    closed = above.closed or hidden or (aside and (tag in ASIDE_TAGS or not CLOSED_WORDS.isdisjoint(names)))
    kind = above.kind
    if tag == "header" and above.kind == 1 and not hidden:
        # The head of an article holds its title.
        return Element(tag, 1, above.closed, number, names)
    if aside:
        kind = -1
    elif (tag == "main" or found.get("role") == "main") or (tag == "article" and not above.closed):
        kind, closed = 1, False
    return Element(tag, kind, closed, number, names)


def blocks(html: str) -> list[Block]:
    """The runs of text of a page, in order, white space turned into one space, with what stands around them."""
    out: list[Block] = []
    stack = [Element("", 0, False, 0, ())]
    piece: list[str] = []
    linked = borders = number = links = 0
    pattern, at, end, endless = _TAG, 0, len(html), set()

    def close() -> None:
        nonlocal linked, borders
        text = " ".join(unescape("".join(piece)).split())
        piece.clear()
        if text:
            own = stack[-1]
            holder = next((e for e in reversed(stack) if e.tag not in INLINE), own)
            parent = stack[stack.index(holder) - 1].number if holder.tag in ("p", "li", *HEADINGS) and len(stack) > 1 else holder.number
            out.append(Block(text, holder.tag, own.kind, parent, own.names, min(linked, len(text)), borders))
            borders = 0
        linked = 0

    def pop(upto: int) -> None:
        nonlocal links, borders
        for e in stack[upto:]:
            links -= e.tag == "a"
            borders += e.tag not in INLINE
        del stack[upto:]

    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            begin = end
        if begin > at:
            piece.append(html[at:begin])
            if links:
                linked += len(html[at:begin].strip())
            at = begin
            if at == end:
                break
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        following = html[at + 1 : at + 2]
        if following in ("!", "?") and following:
            stop = html.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        found = pattern.match(html, at)
        if not found and pattern is _TAG and _LOOSE.match(html, at):
            # A quote that never ends: from here on quotes don't count.
            pattern = _LOOSE
            found = pattern.match(html, at)
        if not found:
            piece.append("<")
            at += 1
            continue
        at = found.end()
        closing, tag, raw = found[1], found[2].lower(), found[3]
        if closing:
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if tag not in INLINE:
                close()
            if place and not (tag in INLINE and any(e.tag not in INLINE for e in stack[place:])):
                pop(place)
            continue
        if tag in RAW:
            close()
            if raw.endswith("/") and tag in ("svg", "math"):
                continue
            stop = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            if tag == "head" and not stop:
                stop = re.compile(r"(?=<body\b)", re.I).search(html, at)
            if not stop:
                endless.add(tag)
            at = stop.end() if stop else end if tag in OPAQUE else at
            continue
        if tag not in INLINE:
            close()
            shut = CLOSES.get(tag)
            if shut:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in shut:
                        pop(k)
                        break
                    if stack[k].tag in CLOSES_AT and stack[k].tag not in shut:
                        break
            borders += 1
        elif tag == "br":
            piece.append(" ")
        if tag in VOID:
            borders += tag not in INLINE
            continue
        number += 1
        stack.append(_element(tag, raw, stack[-1], number))
        links += tag == "a"
    close()
    return out


def look(block: Block, place: int, total: int) -> list[str]:
    """What the model sees of a block; nothing of the elements that label it."""
    size, share = len(block.text), block.linked / len(block.text)
    return [
        f"tag={block.tag if block.tag in HEADINGS or block.tag in ('p', 'li', 'td', 'div', 'pre', 'blockquote') else 'other'}",
        f"size={min(9, int(math.log2(size + 1)))}",
        f"linked={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"mark={bool(_MARK.search(block.text))}",
        f"words={min(4, block.text.count(' ') // 5)}",
        f"place={'first' if place * 10 < total else 'last' if place * 10 >= 9 * total else 'inside'}",
        *(f"name={x}" for x in set(block.names) - ASIDE_WORDS),
    ]


def learn(counts: Iterable[tuple[str, int, int]]) -> dict[str, float]:
    """Log odds of content for every feature, from (feature, kind, times), smoothed."""
    times: dict[str, Counter] = {}
    for feature, kind, n in counts:
        times.setdefault(feature, Counter())[kind] += n
    total = times.pop("", Counter())
    if not total[1] or not total[-1]:
        return {}
    odds = lambda c: math.log((c[1] + 1) / (total[1] + 2)) - math.log((c[-1] + 1) / (total[-1] + 2))
    return {feature: odds(c) for feature, c in times.items()}


def costs(page: list[Block], model: dict[str, float]) -> list[int]:
    """For each block what it costs to call it boilerplate, less what it costs to call it content."""
    out = []
    for place, block in enumerate(page):
        odds = sum(model.get(x, 0.0) for x in look(block, place, len(page)))
        out.append(round(UNIT * (max(-MODEL, min(MODEL, odds)) + MARKUP * block.kind)))
    return out


def edges(page: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness: blocks in a row, and the blocks of one element in a row."""
    out: Counter = Counter()
    last: dict[int, int] = {}
    for k, block in enumerate(page):
        if k:
            out[k - 1, k] += round(UNIT * SMOOTH / (1 + max(0, block.borders - 2)))
        if (before := last.get(block.parent)) is not None:
            out[before, k] += round(UNIT * SMOOTH / 2)
        last[block.parent] = k
    return [(a, b, c) for (a, b), c in out.items() if c]


def minimum_cut(cost: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut, the least such side. A node with positive
    cost pays it off this side, one with negative cost pays it on this side; an edge that is cut pays its capacity."""
    near: list[dict[int, int]] = [{} for _ in cost]
    for a, b, c in joined:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    own, total = list(cost), [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * len(cost)
    todo = deque(range(len(cost)))
    while todo:
        k = todo.popleft()
        if side[k] is not None or -total[k] < own[k] <= total[k]:
            continue
        # No labelling of the others makes the other side cheaper.
        side[k] = own[k] > 0
        for other, c in near[k].items():
            if side[other] is None:
                own[other] += c if side[k] else -c
                total[other] -= c
                todo.append(other)
    rest = [k for k, s in enumerate(side) if s is None]
    if rest:
        reached = _reached(rest, own, near, side)
        for k in rest:
            side[k] = k in reached
    return [bool(s) for s in side]


def _reached(rest: list[int], own: list[int], near: list[dict[int, int]], side: list[bool | None]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow, by levels and blocking flows."""
    source, sink = -1, -2
    left: dict[int, dict[int, int]] = {k: {j: c for j, c in near[k].items() if side[j] is None} for k in rest}
    left[source], left[sink] = {}, {}
    for k in rest:
        if own[k] > 0:
            left[source][k], left[k][source] = own[k], 0
        elif own[k] < 0:
            left[k][sink], left[sink][k] = -own[k], 0
    while True:
        level, row = {source: 0}, deque([source])
        while row:
            k = row.popleft()
            for j, c in left[k].items():
                if c > 0 and j not in level:
                    level[j] = level[k] + 1
                    row.append(j)
        if sink not in level:
            level.pop(source)
            return set(level)
        turn = {k: iter(list(left[k])) for k in level}
        path = [source]
        while path:
            k = path[-1]
            if k == sink:
                least = min(left[a][b] for a, b in zip(path[:-1], path[1:], strict=True))
                full = len(path)
                for n, (a, b) in enumerate(zip(path[:-1], path[1:], strict=True)):
                    left[a][b] -= least
                    left[b][a] = left[b].get(a, 0) + least
                    if not left[a][b]:
                        full = min(full, n)
                # What lies before the first full edge goes on; that edge's own turn stays with its node.
                del path[full + 1 :]
                continue
            step = next((j for j in turn[k] if left[k][j] > 0 and level.get(j) == level[k] + 1), None)
            if step is None:
                path.pop()
            else:
                path.append(step)
    raise AssertionError


def main_text(html: str, model: dict[str, float]) -> str:
    page = blocks(html)
    kept = minimum_cut(costs(page, model), edges(page))
    return "\n\n".join(block.text for block, keep in zip(page, kept, strict=True) if keep)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in w.blocks(batches, "html"):
        counts: Counter = Counter()
        for html in batch.column("html").to_pylist():
            page = blocks(html or "")
            for place, block in enumerate(page):
                if block.kind:
                    counts.update((x, block.kind) for x in ["", *look(block, place, len(page))])
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            ["feature", "kind", "n"],
        )


def train(pages: DataFrame, *, sample: int = SAMPLE, page_id: str = "page_id", html: str = "html") -> dict[str, float]:
    """The model: log odds of at most some thousand features, from `sample` pages."""
    narrow = prefixed(pages, page_id=page_id, html=html).withColumn("html", F.col("html").cast("string"))
    chosen = narrow.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = narrow.join(F.broadcast(chosen), "page_id", "left_semi").select("html")
    counted = rows.mapInArrow(_features, "feature string, kind int, n long").groupBy("feature", "kind").agg(F.sum("n").alias("n"))
    # A name that two blocks have says little; the rest is at most what the sample's class names are.
    return learn((r["feature"], r["kind"], r["n"]) for r in counted.where("n > 2").collect())


def extract(
    pages: DataFrame, *, model: dict[str, float] | None = None, sample: int = SAMPLE,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """page_id, url, text (main text, blocks joined by two newlines)."""
    if model is None:
        model = train(pages, sample=sample, page_id=page_id, html=html)
    narrow = prefixed(pages, page_id=page_id, url=url, html=html).withColumn("html", F.col("html").cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "html"):
            texts = [main_text(x or "", model) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")
