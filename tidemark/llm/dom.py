"""A small tolerant reader of HTML: block elements as a tree, with the runs of text they hold."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>?)",
    re.S,
)
_NAME = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "caption tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html frameset caption tbody td tfoot th thead tr dd dt li legend".split()) | {"dd", "dt", "li"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
UNSEEN = frozenset("head noscript template svg math object select button datalist audio video canvas".split())
P_ENDS = ("td", "th", "caption", "button", "table")
SIBLINGS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"),
    "tfoot": ("tbody thead tr td th", "table"), "thead": ("tbody tr td th", "table"),
}
SIBLINGS = {tag: (names.split(), until.split()) for tag, (names, until) in SIBLINGS.items()}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    text: str | None = None  # of a leaf: one run of text, white space single
    linked: int = 0  # characters of it that stand in links
    children: list[int] = field(default_factory=list)


def name_tokens(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and itemprop, in lower case."""
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in _NAME.findall(attributes))
    return tuple(sorted({p.lower() for p in _PART.findall(found)}))


def parse(page: str) -> list[Node]:
    """Nodes in page order; node 0 is the page. Leaves carry the runs of text between block borders.

    Comments, scripts, styles and other unseen content are left out. End tags may be missing or stray,
    a tag cut off at the end of the page is dropped, and a page of plain text is one leaf.
    """
    nodes = [Node("#page", -1, 0)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; an inline one has its block's node
    places: dict[str, list[int]] = {}  # where in the stack each open element stands, by name
    blocks: list[int] = []  # and where the blocks do
    run: list[tuple[str, bool]] = []
    links = unseen = 0

    def flush() -> None:
        if run:
            text = " ".join("".join(t for t, _ in run).split())
            if text:
                at = stack[-1][1]
                linked = sum(len("".join(t.split())) for t, inside in run if inside)
                nodes[at].children.append(len(nodes))
                nodes.append(Node("#text", at, nodes[at].depth + 1, (), text, linked))
            run.clear()

    def enter(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append((tag, node))

    def leave(k: int) -> None:
        nonlocal links, unseen
        if blocks and blocks[-1] >= k:
            flush()
        for t, _ in stack[k:]:
            links -= t == "a"
            unseen -= t in UNSEEN
            places[t].pop()
        while blocks and blocks[-1] >= k:
            blocks.pop()
        del stack[k:]

    def last(names: Iterable[str]) -> int:
        """Where the innermost open element of these names stands; 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close_among(names: Iterable[str], until: Iterable[str]) -> None:
        # one of several nested cells or rows may remain
        while (k := last(names)) > last(until):
            leave(k)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            if not unseen and at < len(page):
                run.append((html.unescape(page[at:]), links > 0))
            break
        if m.start() > at and not unseen:
            run.append((html.unescape(page[at : m.start()]), links > 0))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[4]:  # a quote was left open: the tag ends at the next bracket, or never
            end = page.find(">", at)
            if end < 0:
                break
            at = end + 1
        if m[1]:
            if tag == "br" or tag == "p" and not places.get("p"):
                run.append((" ", links > 0))
                continue
            k = last((tag,))
            if k and (tag in BLOCKS or tag in UNSEEN or not blocks or blocks[-1] < k):
                leave(k)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "body" or tag in BLOCKS and unseen and places.get("head"):
            close_among(("head",), ())
        if tag in SIBLINGS:
            close_among(*SIBLINGS[tag])
        if tag in CLOSES_P and places.get("p"):
            close_among(("p",), P_ENDS)
        if tag in BLOCKS:
            flush()
            if tag in VOID or tag in ("html", "body") and places.get(tag):
                continue
            parent = stack[-1][1]
            nodes[parent].children.append(len(nodes))
            enter(tag, len(nodes))
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, name_tokens(m[3])))
        elif tag in VOID:
            if tag in ("br", "img", "input", "wbr"):
                run.append(("" if tag == "wbr" else " ", links > 0))
        elif not m[3].endswith("/") or tag == "a":
            enter(tag, stack[-1][1])
            links += tag == "a"
            unseen += tag in UNSEEN
    flush()
    return nodes
