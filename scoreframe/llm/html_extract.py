"""HTML extraction by tree scoring.

A lenient parser builds the element tree; every paragraph passes points for its length and commas to its ancestors,
discounted by its link density; boilerplate elements are cut, those marked by class, id or role only if they don't hold
most of the page's points; the best container is kept with the siblings that score near it. Its text is written as one
line per block.

Defined cases: null and empty pages give an empty text; repeated rows stay; an empty table gives no rows; a page
without any scoring paragraph gives the text of its article, main or body. Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav header footer aside form script style noscript iframe template svg canvas button select textarea input object embed video audio title menu dialog".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
#: Elements whose end may be left out: the tags that end (the nearest of them), and the tags that hide them.
OPEN_ENDS = (
    (frozenset(("p",)), frozenset("table td th caption button html body".split())), (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), (frozenset(("dt", "dd")), frozenset(("dl",))),
    (frozenset(("tr", "td", "th")), frozenset(("table",))), (frozenset(("td", "th")), frozenset(("tr", "table"))), (frozenset(("option",)), frozenset(("select",))),
)
CLOSED_BY = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
CLOSE_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "p"} | {"p"}

TOUCHED = frozenset().union(*(tags for pair in OPEN_ENDS for tags in pair))

#: Words of class, id and role that mark boilerplate, whole and as beginnings; weak ones only as a whole name or its end,
#: and the weakest only as a whole name.
MARKED = frozenset("ad ads nav menu sidebar side footer header masthead cookie cookies consent notice notices banner promo promos promoted share sharing social related popup modal overlay toolbar subscribe signup login search breadcrumb breadcrumbs pagination pager widget comment comments disqus respond replies reply discussion sponsor sponsored outbrain taboola newsletter navigation complementary contentinfo alert gdpr skip".split())
WEAK = frozenset("header notice notices alert discussion search reply replies respond skip overlay login banner modal toolbar complementary".split())
WEAKEST = frozenset(("side", "widget"))
MARKED_START = ("advert", "comment", "sidebar", "cookie", "newsletter", "breadcrumb", "sponsor", "navbar", "topbar", "navig")
#: Words that only say what kind of box, place or service a marked name stands for. A name with any other word beside the
#: marked one tells of content: related-posts is a box, related-work a section.
STRUCTURAL = frozenset(
    "above area article articles author avatar bar below block body bottom box button buttons card cards col column container content copyright count entry facebook feed field follow form global group head holder horizontal"
    " icon icons image images inline inner input item items label leaderboard left link links list main media meta message module more outer page panel parent post posts primary rectangle right row secondary section site slot"
    " skyscraper sticky stories story stream text thread title top twitter unit us user vertical wrap wrapper".split()
)
KEPT = frozenset(("html", "body", "main"))

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>", re.S)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_NAME = re.compile(r"\S+")


class Node:
    __slots__ = ("tag", "marks", "parent", "children", "score", "total", "named", "saved", "ends")

    def __init__(self, tag: str, marks: str, parent: Node | None):
        self.tag, self.marks, self.parent, self.children, self.score = tag, marks, parent, [], 0.0
        self.total, self.named, self.saved = 0.0, 0.0, False  # points of the subtree, those in article or main; marked, but kept


def parse(page: str) -> Node:
    """The element tree; comments, declarations and raw elements leave no text. Every step is paid for by the characters
    that it passes or the elements that it closes, so broken pages take linear time too."""
    root = Node("#root", "", None)
    root.ends = (None,) * len(OPEN_ENDS)  # the nearest element of each kind whose end may be left out
    at, here, opened = 0, root, Counter()
    size, last = len(page), page.rfind(">")

    def close(node: Node) -> None:
        nonlocal here
        while True:
            gone, here = here, here.parent
            opened[gone.tag] -= 1
            if gone is node:
                return

    while at < size:
        found = _TOKEN.search(page, at) if at <= last or page.find("<!", at) >= 0 or page.find("<?", at) >= 0 else None
        if found is None:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if opened[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        if tag in CLOSE_P and here.ends[0] is not None:
            close(here.ends[0])
        if tag in CLOSED_BY and here.ends[CLOSED_BY[tag]] is not None:
            close(here.ends[CLOSED_BY[tag]])
        attributes = found[3]
        marks = " ".join((m[2] or m[3] or m[4] or "").lower() for m in _MARK.finditer(attributes)) if "=" in attributes else ""
        node = Node(tag, marks, here)
        node.ends = here.ends
        if tag in TOUCHED:
            node.ends = tuple(node if tag in own else None if tag in hiding else near for near, (own, hiding) in zip(here.ends, OPEN_ENDS, strict=True))
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at) if at <= last else None
            at = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            here = node
            opened[tag] += 1
    return root


def is_marked(node: Node) -> bool:
    if not node.marks or node.tag in KEPT:
        return False
    for name in _NAME.findall(node.marks):
        words = [w for w in _WORD.findall(name) if len(w) > 1]
        if not all(w in MARKED or w in WEAKEST or w in STRUCTURAL or w.startswith(MARKED_START) for w in words):
            continue
        for i, w in enumerate(words):
            if w in WEAKEST:
                if len(words) == 1:
                    return True
            elif w in WEAK:
                if i == len(words) - 1:
                    return True
            elif w in MARKED or w.startswith(MARKED_START):
                return True
    return False


def is_dropped(node: Node) -> bool:
    return node.tag in DROPPED


def is_boilerplate(node: Node) -> bool:
    return node.tag in DROPPED or (not node.saved and is_marked(node))


def _walk(node: Node, cut: Callable[[Node], bool] = is_boilerplate) -> Iterator[tuple[str, object]]:
    """("open", node), ("text", str), ("close", node) in page order, without what is cut; no recursion."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    yield "open", node
    while stack:
        here, k = stack.pop()
        if k == len(here.children):
            yield "close", here
            continue
        stack.append((here, k + 1))
        child = here.children[k]
        if isinstance(child, str):
            yield "text", child
        elif not cut(child):
            yield "open", child
            stack.append((child, 0))


def _scored(root: Node, cut: Callable[[Node], bool] = is_boilerplate) -> list[Node]:
    """Passes points up: all to the parent, half to the next, a third of the level's share beyond, four levels. Sums them
    over each subtree as well."""
    candidates, open_paragraphs, links = {}, [], 0
    for kind, what in _walk(root, cut):
        if kind == "text" and open_paragraphs:
            words = html.unescape(what)
            box = open_paragraphs[-1]
            n = len("".join(words.split()))
            box[1] += n
            box[2] += words.count(",")
            box[3] += n if links else 0
        elif kind == "open":
            what.score = what.total = what.named = 0.0
            links += what.tag == "a"
            if what.tag in PARAGRAPHS:
                open_paragraphs.append([what, 0, 0, 0])
        elif kind == "close":
            links -= what.tag == "a"
            if open_paragraphs and open_paragraphs[-1][0] is what:
                _, n, commas, linked = open_paragraphs.pop()
                if n >= 2:
                    points = (1 + commas + min(n / 100, 3)) * (1 - linked / n)
                    what.total += points
                    up, level = what.parent, 0
                    while up is not None and level < 4:
                        up.score += points / (1, 2, 6, 9)[level]
                        candidates[id(up)] = up
                        up, level = up.parent, level + 1
            if what.tag in ("article", "main") and not is_marked(what):
                what.named = what.total
            if what.parent is not None:
                what.parent.total += what.total
                what.parent.named += what.named
    return list(candidates.values())


def _save(root: Node) -> None:
    """Saves marked elements from the cut: those with more than half of the page's points, or with more than half of the
    points in unmarked article and main and a quarter of all; every one if the page had no points without them."""
    marked = [w for k, w in _walk(root, is_dropped) if k == "open" and is_marked(w)]
    if not marked:
        return
    _scored(root, is_dropped)
    for node in marked:
        node.saved = node.total > 0.5 * root.total or (node.named > 0.5 * root.named and node.total >= 0.25 * root.total)
    if root.total > 0:
        _scored(root)
        if root.total == 0:
            for node in marked:
                node.saved = True


def _main(root: Node) -> list[Node]:
    _save(root)
    candidates = [n for n in _scored(root) if n.parent is not None]
    if not candidates:
        named = [w for k, w in _walk(root) if k == "open" and w.tag in ("article", "main", "body")]
        return [min(named, key=lambda n: ("article", "main", "body").index(n.tag))] if named else [root]
    best = max(candidates, key=lambda n: n.score)
    up = best
    while up is not None and up.tag not in ("article", "main", "body"):
        up = up.parent
    if up is not None and up.tag in ("article", "main"):
        # a semantic container around the best one holds its siblings as well; an article may be one of several
        return [n for n in up.parent.children if n is up or (isinstance(n, Node) and n.tag == up.tag == "article" and not is_boilerplate(n) and n.total >= max(3.0, 0.2 * up.total))]
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    kept = []
    for child in best.parent.children:
        if isinstance(child, Node) and not is_boilerplate(child) and (child is best or child.score >= max(3.0, 0.2 * best.score) or (child.tag in PARAGRAPHS and best.parent.score > 0) or re.fullmatch("h[1-6]", child.tag)):
            kept.append(child)
    return kept


def extract(page: str | None) -> str:
    """The main text: one line per block, white space folded."""
    if not page:
        return ""
    blocks, line = [], []

    def end() -> None:
        if line:
            folded = " ".join(html.unescape("".join(line)).split())
            if folded:
                blocks.append(folded)
            line.clear()

    for part in _main(parse(page)):
        for kind, what in _walk(part):
            if kind == "text":
                line.append(what)
            elif what.tag in BLOCK:
                end()
            elif what.tag == "br" and kind == "open":
                line.append(" ")
        end()
    return "\n".join(blocks)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
