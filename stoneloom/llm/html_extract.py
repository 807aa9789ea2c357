"""Main text of HTML pages by tree scoring.

One pass over the markup builds a light tree: elements, their blocks of text, and for each block
the characters that stand in links. A block is the text between block-level tags: references of each
run of text decoded, white space to single spaces, trimmed. Scripts, styles and hidden elements have no text.

*Weights.* An element's tag, role and the words of its class and id give it a weight: ``AGAINST`` for
what a menu, footer, sidebar, advert, form or reader comment is called, ``DOUBT`` for words that may also be
a topic, nothing for others. Its text weighs up to ``PROSE`` for it: the share that stands in
paragraphs of prose, less the share in links. A subtree whose weights add up to less than nothing is left out.
A header gives its headings at most.

*Scores.* Every paragraph passes 1 point, 1 for each comma and up to 3 for its length, less the share of its
links, to its container; a container passes half of what it has to the next one, or all of it if nothing
else has points there. Points count less by the share of links, twice for an article or main
element and a quarter more for names of content. The container with the highest score wins, the deeper one among equals.

*Neighbours.* From the best container up to the body, siblings stay that hold prose with few links or a fifth of
its score, and headings; further up than the first level prose must be a long paragraph. Nothing outside an article or main
element joins it but other articles of a fifth of its score. Inside what stays all blocks stay, but lists of short
links before the first paragraph. Blocks are joined by two line ends.

Work is in proportion to the page: sums run up the tree once and flags down once.

Defined results: a null page is empty; a page without a paragraph gives all blocks of no weight against
them that are not mostly links; markup that ends early is closed at its end; equal rows are extracted each;
other columns play no part. Nothing is capped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import table

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg iframe textarea select title object canvas video audio".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "dd", "li", "div", "section", "article", "main", "body"}
CONTAINERS = {"div", "section", "article", "main", "body", "td", "blockquote", "html", "center", "table", "ul", "ol", "dl", "figure", "details"}
LISTS = {"ul", "ol"}
#: What an opening tag closes if it is still open, and the elements beyond which it closes nothing.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
IN_P = BLOCK - {"td", "th", "tr", "caption", "tbody", "thead", "tfoot", "html", "body"}

#: Weights of names; a text of nothing but prose without links weighs as much as ``PROSE``.
AGAINST, DOUBT, PROSE = -9, -3, 4
TAGS = dict.fromkeys("nav footer aside form button dialog menu head fieldset".split(), AGAINST)
ROLES = dict.fromkeys("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split(), AGAINST)
NAMES = dict.fromkeys(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsbygoogle sponsor sponsored sponsors promo promos banner banners"
    " outbrain taboola nav navbar breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets footer foot footers masthead"
    " topbar toolbar comment comments commentlist disqus reply replies respond cookie cookies consent gdpr popup modal overlay newsletter"
    " subscribe signup login paywall".split(),
    AGAINST,
) | dict.fromkeys(
    "promotion navigation menu menus toc skip related recommended recommendations trending popular discussion reactions notice notices"
    " alert alerts subscription share sharing social follow tags copyright legal disclaimer form search warning feedback thread".split(),
    DOUBT,
)
HEADERS = {"header", "headers"}
CONTENT = set("article content body entry main post story text".split())
ABOUT = {"has", "with", "no", "not", "without", "show", "hide", "is"}
TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORDS = re.compile(r"[a-z]+(?=[^a-z]|$)|[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """``skip``: its text isn't read; ``head``: inside a header; sums of its own blocks, then of its subtree."""

    __slots__ = ("block", "boost", "container", "depth", "gone", "head", "kept", "kind", "kids", "links", "long", "parent", "points", "prose", "scoring", "size", "skip", "weight")

    def __init__(self, kind: str, parent: Node | None, weight: int = 0, skip: bool = False, head: bool = False, boost: float = 1):
        self.kind, self.parent, self.weight, self.skip, self.head, self.boost = kind, parent, weight, skip, head, boost
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if kind in BLOCK or not parent else parent.block
        self.container = self if kind in CONTAINERS or not parent else parent.container
        self.size = self.links = self.prose = self.long = 0
        self.points = 0.0
        self.scoring = 0  # containers below that have points
        self.gone = self.kept = False
        self.kids: list[Node] = []
        if parent and self.block is self:
            parent.block.kids.append(self)

    @property
    def score(self) -> float:
        return self.points * self.boost * (1 - min(1.0, self.links / max(1, self.size)))

    def few_links(self) -> bool:
        return 4 * self.links < max(1, self.size)


def names_of(kind: str, raw: str) -> tuple[int, bool, bool, float]:
    """Weight of an element's attributes; whether they hide it, call it a header, and how they call it content."""
    weight, header, boost = 0, False, 1.0
    if kind == "header":
        header = True
    if not raw or raw.isspace():
        return weight, False, header, boost
    low = raw.lower()
    if not ("class" in low or "id" in low or "role" in low or "hidden" in low or "style" in low):
        return weight, False, header, boost
    attrs = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(raw)}
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return 0, True, header, boost
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return 0, True, header, boost
    weight = ROLES.get(attrs.get("role", "").lower(), 0)
    if kind in ("html", "body", "main") or kind in HEADINGS:
        return weight, False, header, boost
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        before = ""
        for w in map(str.lower, WORDS.findall(name)):
            # "has-sidebar" says something of what an element holds, not of what it is
            if before not in ABOUT:
                # an article is called what it is about; a paragraph is text whatever its topic
                said = NAMES.get(w, 0) if kind != "article" or w.startswith("comment") else 0
                weight = min(weight, said if said == AGAINST or kind in CONTAINERS else 0)
                header |= w in HEADERS and kind != "article"
                boost = 1.25 if w in CONTENT else boost
            before = w
    return weight, False, header, boost


def tree_of(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, parents first, and (element, text, characters inside links) of every block, in page order."""
    root = Node("html", None)
    nodes, stack, out = [root], [root], []
    opened: Counter = Counter()
    text: list[str] = []
    linked = anchors = 0
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            if words:
                out.append((stack[-1].block, " ".join(words), linked))
            text.clear()
            linked = 0

    def close(to: int) -> None:
        nonlocal anchors
        for node in stack[to:]:
            opened[node.kind] -= 1
            anchors -= node.kind == "a"
        del stack[to:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1].skip:
            run = html[at:lt]
            text.append(unescape(run) if "&" in run else run)
            linked += (lt - at) * (anchors > 0)
        if lt == n:
            break
        m = TAG.match(html, lt)
        if not m:
            if not stack[-1].skip:
                text.append("<")
            at = lt + 1
            continue
        at = m.end()
        kind = (m[2] or m[5] or "").lower()
        if not kind:
            continue
        raw = m[3] or m[6] or ""
        if m[1] or m[4]:
            if kind == "br":
                text.append(" ")
            if kind in BLOCK:
                flush()
            if opened[kind]:
                i = len(stack) - 1
                while i and stack[i].kind != kind:
                    # an inline end tag closes nothing beyond its block
                    i = i - 1 if kind in BLOCK or stack[i].kind not in BLOCK else 0
                if i:
                    close(i)
            continue
        if kind in RAW:
            end = re.compile(rf"</{re.escape(kind)}[\s/>]", re.I).search(html, at) if not raw.endswith("/") else None
            if end:
                at = html.find(">", end.start()) + 1 or n
            elif not raw.endswith("/") and kind in ("script", "style", "textarea", "title"):
                at = n
            continue
        if kind in VOID:
            if kind in BLOCK:
                flush()
            elif not stack[-1].skip:
                text.append(" ")
            continue
        if kind in BLOCK:
            flush()
            if kind in IN_P and opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].kind == "p":
                        close(i)
                        break
                    if stack[i].kind in CONTAINERS or stack[i].kind == "th":
                        break
            if kind in CLOSES:
                targets, scope = CLOSES[kind]
                if any(opened[x] for x in targets):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].kind in scope:
                            break
                        if stack[i].kind in targets:
                            close(i)
                            break
            if kind in HEADINGS and stack[-1].kind in HEADINGS:
                close(len(stack) - 1)
        if kind in ("body", "html"):
            if opened["head"]:
                close(next(i for i, x in enumerate(stack) if x.kind == "head"))
            if kind == "html":
                continue
        parent = stack[-1]
        weight, hidden, header, boost = (0, False, False, 1.0) if parent.skip else names_of(kind, raw)
        weight = min(weight, TAGS.get(kind, 0))
        if raw.endswith("/") and kind not in BLOCK:
            continue
        # prose can't make up for this weight, so what is below needs no reading
        skip = parent.skip or hidden or weight + PROSE < 0
        node = Node(kind, parent, weight, skip, parent.head or header, 2.0 if kind in ("article", "main") else boost)
        stack.append(node)
        nodes.append(node)
        opened[kind] += 1
        anchors += kind == "a"
    flush()
    return nodes, out


def is_prose(holder: Node, text: str, linked: int) -> bool:
    """Whether a block is a paragraph of prose."""
    return holder.kind in PARAGRAPHS and (len(text) >= 80 or not linked and text[-1] in ".!?。！？…") and 4 * linked < len(text)


def points_of(text: str, linked: int) -> float:
    commas = text.count(",") + text.count("،") + text.count("、") + text.count("，")
    return (1 + commas + min(len(text) / 100, 3)) * (1 - min(1.0, linked / len(text)))


def weigh(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Sums up the tree, the weights against subtrees, and points."""
    for holder, text, linked in blocks:
        if holder.head:
            continue
        holder.size += len(text)
        holder.links += linked
        if is_prose(holder, text, linked):
            holder.prose += len(text)
            holder.long += len(text) >= 80
        if holder.kind not in HEADINGS:
            holder.container.points += points_of(text, linked)
    passed: dict[int, float] = {}
    for node in reversed(nodes):
        if node.container is node:
            below = passed.get(id(node), 0.0)
            node.points += below if node.scoring == 1 and not node.points else below / 2
        if node.weight and node.weight + PROSE * node.prose / max(1, node.size) * (1 - node.links / max(1, node.size)) < 0:
            node.gone = True
        up = node.parent
        if up and not node.gone:
            up.size += node.size
            up.links += node.links
            up.prose += node.prose
            up.long += node.long
            if node.container is node and node.points:
                passed[id(up.container)] = passed.get(id(up.container), 0.0) + node.points
                up.container.scoring += 1
    for node in nodes:
        node.gone |= bool(node.parent and node.parent.gone)


def neighbours(best: Node) -> tuple[set[int], dict[int, bool]]:
    """Elements beside the best container that stay, and the elements around it (whether it is the first)."""
    kept, around = {id(best)}, {}
    level, first = best, True
    while level.parent and level.kind != "body":
        outer = level.block.parent
        if outer is None:
            break
        outer = outer.block
        bounded = level.kind in ("article", "main")
        for x in outer.kids:
            if x is level or x.gone or x.head or not x.few_links() or not x.size:
                continue
            enough = 5 * x.score >= best.score
            if bounded or x.kind == "article":
                stays = x.kind == level.kind == "article" and enough
            elif x.kind in HEADINGS:
                stays = first or outer.kind not in ("body", "html")
            else:
                stays = bool(x.prose if first else x.long) or x.kind in CONTAINERS and enough
            if stays:
                kept.add(id(x))
        if bounded:
            break
        around[id(outer)] = first
        level, first = outer, False
    return kept, around


def menu_items(blocks: list[tuple[Node, str, int]], inside: list[bool]) -> set[int]:
    """Blocks of lists of short links that come before the first paragraph of prose that stays."""
    out = set()
    for i, (holder, text, linked) in enumerate(blocks):
        if not inside[i]:
            continue
        if is_prose(holder, text, linked):
            break
        listed = holder.kind == "li" and holder.parent.kind in LISTS
        if listed and 10 * linked >= 8 * len(text) and 10 * holder.parent.links >= 8 * holder.parent.size and len(text) < 25:
            out.add(i)
    return out


def main_text(html: str | None) -> str:
    nodes, blocks = tree_of(html or "")
    if not blocks:
        return ""
    weigh(nodes, blocks)
    best = max((x for x in nodes if x.container is x and not x.gone), key=lambda x: (x.score, x.depth), default=nodes[0])
    if not best.score:
        return "\n\n".join(t for holder, t, linked in blocks if not holder.gone and not holder.head and 2 * linked < len(t))
    kept, around = neighbours(best)
    for node in nodes:
        node.kept = id(node) in kept or bool(node.parent and node.parent.kept)
    inside = []
    for holder, text, linked in blocks:
        stays = holder.kept or id(holder) in around and is_prose(holder, text, linked) and (around[id(holder)] or len(text) >= 80)
        if holder.head:  # the best container's headings, not the site's
            stays = stays and holder.kind in HEADINGS and best.kind not in ("body", "html")
        inside.append(stays and not holder.gone)
    menus = menu_items(blocks, inside)
    return "\n\n".join(text for i, (_, text, _) in enumerate(blocks) if inside[i] and i not in menus)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extract": op7_html_extract}
ORACLES: dict[str, str] = {}
