"""HTML extraction: boosted trees over DOM nodes, decoded so that no kept node lies in a dropped one."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.boosting import Trees, fit_trees
from tidemark.llm.common import table
from tidemark.llm.dom import Node, parse

SAMPLE_PAGES = 150  # pages whose texts the training layouts are made of
SAMPLE_CHARS = 60_000
LAYOUTS = 3  # per sampled page
MAX_TOKENS = 110

TAGS = "p h1 h2 h3 li ul ol div section article main nav header footer aside form table td figure figcaption blockquote pre dl body".split()
ABOVE = "article main nav header footer aside form section table ul figure".split()
NUMBERS = 16
AT_ONCE = 10_000  # nodes that are scored together


@dataclass(frozen=True)
class Model:
    trees: Trees
    tokens: dict[str, int]  # those that the trees ask for

    def texts(self, pages: Iterable[str]) -> Iterator[str]:
        """The article of each page. Pages are scored together, up to ``AT_ONCE`` nodes or one long page."""
        held, size = [], 0
        for page in pages:
            held.append(parse(page))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from self._articles(held)
                held, size = [], 0
        if held:
            yield from self._articles(held)

    def text(self, page: str) -> str:
        return next(self.texts([page]))

    def _articles(self, pages: list[list[Node]]) -> Iterator[str]:
        logits = self.trees.logits(np.concatenate([node_features(nodes, self.tokens) for nodes in pages]))
        at = 0
        for nodes in pages:
            kept = decode(nodes, logits[at : at + len(nodes)])
            at += len(nodes)
            yield "\n\n".join(n.text for n, k in zip(nodes, kept) if k and n.text is not None)


_STOPS = re.compile("[.,;:!?]")


def node_features(nodes: list[Node], tokens: dict[str, int]) -> np.ndarray:
    """Per node: subtree density, depth, siblings, and names of the element and of what it lies in."""
    n = len(nodes)
    words, linked, chars, stops, leaves, longest, tags = ([0] * n for _ in range(7))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.text is not None:
            words[i] = longest[i] = node.text.count(" ") + 1
            chars[i] = len(node.text)
            linked[i] = node.linked
            stops[i] = len(_STOPS.findall(node.text))
            leaves[i] = 1
        else:
            tags[i] += 1
        p = node.parent
        if p >= 0:
            for a in (words, linked, chars, stops, leaves, tags):
                a[p] += a[i]
            if longest[i] > longest[p]:
                longest[p] = longest[i]
    kids, alike, place, before, after = ([0] * n for _ in range(5))
    for node in nodes:
        names = Counter(nodes[c].tag for c in node.children)
        for at, c in enumerate(node.children):
            kids[c], alike[c], place[c] = len(node.children), names[nodes[c].tag], at
            before[c] = words[node.children[at - 1]] if at else 0
            after[c] = words[node.children[at + 1]] if at + 1 < len(node.children) else 0
    k, m = len(tokens), len(TAGS)
    own, all_up = NUMBERS + m + len(ABOVE), NUMBERS + m + len(ABOVE) + k
    # columns that are set: of the element itself, and of all that it lies in
    mine: list[tuple[int, ...]] = [()] * n
    above: list[frozenset[int]] = [frozenset()] * n
    rows, columns = [], []
    for i, node in enumerate(nodes):
        if i and node.text is not None:  # a run of text goes by the name of its element
            mine[i], above[i] = mine[node.parent], above[node.parent]
        elif i:
            found = [tokens[t] for t in node.tokens if t in tokens]
            mine[i] = (*_TAG_AT.get(node.tag, ()), *[own + t for t in found])
            fresh = {*_ABOVE_AT.get(node.tag, ()), *[all_up + t for t in found]}
            above[i] = above[node.parent] if fresh <= above[node.parent] else above[node.parent] | fresh
        columns += mine[i]
        columns += above[i]
        rows += [i] * (len(mine[i]) + len(above[i]))
    x = np.zeros((n, all_up + k), np.float32)
    x[rows, columns] = 1
    words, linked, chars, stops, leaves, longest, tags, kids, alike, place, before, after = (
        np.array(a, float) for a in (words, linked, chars, stops, leaves, longest, tags, kids, alike, place, before, after)
    )
    parent = np.maximum(np.array([v.parent for v in nodes]), 0)
    x[:, 0] = [v.depth for v in nodes]
    x[:, 1] = np.log1p(words)
    x[:, 2] = linked / np.maximum(chars, 1)
    x[:, 3] = np.log1p(tags)
    x[:, 4] = words / np.maximum(leaves, 1)
    x[:, 5] = stops / np.maximum(words, 1)
    x[:, 6] = np.log1p(longest)
    x[:, 7] = words / np.maximum(words[parent], 1)
    x[:, 8] = np.log1p(words[parent])
    x[:, 9] = words / max(words[0], 1)
    x[:, 10] = kids
    x[:, 11] = alike
    x[:, 12] = place / np.maximum(kids, 1)
    x[:, 13] = np.log1p(before)
    x[:, 14] = np.log1p(after)
    x[:, 15] = chars / np.maximum(tags, 1)
    return x


_TAG_AT = {t: (NUMBERS + i,) for i, t in enumerate(TAGS)}
_ABOVE_AT = {t: (NUMBERS + len(TAGS) + i,) for i, t in enumerate(ABOVE)}


def _narrowed(trees: Trees, tokens: dict[str, int]) -> Model:
    """Only the tokens that some tree asks for, so that only their columns are filled."""
    first, k = NUMBERS + len(TAGS) + len(ABOVE), len(tokens)
    asked = {(f - first) % k for f in trees.feature[np.isfinite(trees.limit)].tolist() if f >= first}
    kept = {t: i for i, t in enumerate(t for t, at in tokens.items() if at in asked)}
    to = {at: kept[t] for t, at in tokens.items() if t in kept}

    def moved(f: int, limit: float) -> int:
        if not np.isfinite(limit):  # an inner node that doesn't split sends all rows left
            return 0
        return f if f < first else first + (f - first) // k * len(kept) + to[(f - first) % k]

    feature = np.array([[moved(f, x) for f, x in zip(*row)] for row in zip(trees.feature.tolist(), trees.limit.tolist())], np.int64)
    return Model(replace(trees, feature=feature), kept)


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """The likeliest set of kept nodes in which every kept node's parent is kept."""
    best = np.clip(logits, -8, 8).astype(float)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = best[0] > 0
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and best[i] > 0
    return kept


# Names that authors give to the parts of a page: fixed values for the training layouts.
MAIN = ("content", "main content", "post body", "entry content", "article body", "story text", "article text", "page content", "post", "prose", "article", "main")
PARTS = {
    "nav": ("nav", "menu", "navigation", "navbar", "main menu", "breadcrumb", "breadcrumbs", "site nav", "tabs", "toc", "pagination", "pager"),
    "header": ("header", "site header", "masthead", "top bar", "page header", "branding", "logo", "banner"),
    "footer": ("footer", "site footer", "bottom", "copyright", "page footer", "legal", "colophon"),
    "aside": ("sidebar", "side bar", "aside", "right rail", "widget", "related", "related posts", "recommended", "trending", "popular", "tags", "share", "social", "author bio"),
    "notice": ("notice", "cookie notice", "cookie banner", "alert", "cookies", "consent", "gdpr", "message", "warning", "announcement", "popup", "modal", "paywall"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adsense", "banner ad", "promotion"),
    "form": ("form", "search form", "newsletter", "subscribe", "login", "signup", "contact form", "search"),
    "comment": ("comments", "comment", "comment list", "reader comments", "replies", "discussion", "responses", "reply", "user comments"),
}


def _named(rng: random.Random, names: tuple[str, ...]) -> str:
    name = rng.choice(names)
    style = rng.randrange(4)
    words = name.split()
    joined = ("-".join(words), "_".join(words), words[0] + "".join(w.title() for w in words[1:]), " ".join(words))[style]
    return f'{"id" if style < 3 and rng.random() < 0.3 else "class"}="{joined}"'


class _Layout:
    """Random pages about given paragraphs; text of the article is wrapped in marks that parsing keeps."""

    MARK = "\ue000"  # a private character

    def __init__(self, rng: random.Random, article: list[str], others: list[str]):
        self.rng, self.article, self.others = rng, article, others

    def say(self, long: bool = False) -> str:
        words = self.rng.choice(self.others).split()
        n = self.rng.randrange(20, 90) if long else self.rng.randrange(1, 14)
        at = self.rng.randrange(max(len(words) - n, 1))
        return html.escape(" ".join(words[at : at + n]))

    def links(self) -> str:
        items = "".join(f'<li><a href="/x">{self.say()}</a></li>' for _ in range(self.rng.randrange(2, 9)))
        return f"<ul>{items}</ul>" if self.rng.random() < 0.8 else items.replace("<li>", "").replace("</li>", " ")

    def part(self, kind: str) -> str:
        rng = self.rng
        name = _named(rng, PARTS[kind])
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comment": "section"}.get(kind)
        tag = semantic if semantic and rng.random() < 0.6 else rng.choice(("div", "div", "section", "p") if kind in ("ad", "notice") else ("div", "div", "section"))
        attrs = "" if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5 else " " + name
        if kind == "nav":
            body = self.links()
        elif kind == "form":
            body = f"<label>{self.say()}</label><input type='text'><p>{self.say()}</p><button>{self.say()}</button>"
            body = body if tag == "form" else f"<form>{body}</form>"
        elif kind == "comment":
            one = lambda: f'<{rng.choice(("div", "li"))} {_named(rng, PARTS["comment"])}><b>{self.say()}</b><p>{self.say(rng.random() < 0.6)}</p>'
            body = f"<h3>{self.say()}</h3>" * (rng.random() < 0.6) + "".join(one() + "</div>" for _ in range(rng.randrange(1, 5)))
            if rng.random() < 0.4:
                body = f"<p>{self.say(True)}</p>" * rng.randrange(1, 4)
        elif kind in ("ad", "notice") or rng.random() < 0.4:
            body = self.say(rng.random() < 0.3)
            body = f"<p>{body}</p>" if tag != "p" and rng.random() < 0.5 else body
        else:
            body = f"<h3>{self.say()}</h3>{self.links()}" if rng.random() < 0.5 else f"<p>{self.say(rng.random() < 0.5)}</p>"
        return f"<{tag}{attrs}>{body}</{tag}>"

    def own(self, text: str, tag: str) -> str:
        return f"<{tag}>{self.MARK}{html.escape(text)}</{tag}>"

    def page(self) -> str:
        rng = self.rng
        blocks = [self.own(self.article[0], rng.choice(("h1", "h1", "h2")))]
        for text in self.article[1:]:
            kind = rng.random()
            blocks.append(self.own(text, "p" if kind < 0.8 else "h2" if len(text) < 80 and kind < 0.9 else "blockquote" if kind < 0.93 else "p"))
            if rng.random() < 0.06:
                cells = "".join(f"<li>{self.MARK}{self.say()}</li>" for _ in range(rng.randrange(2, 5)))
                blocks.append(f"<ul>{cells}</ul>")
        inside = [self.part(k) for k in ("ad", "aside", "notice", "comment", "form") if rng.random() < 0.18]
        for part in inside:
            blocks.insert(rng.randrange(1, len(blocks) + 1), part)
        tag = rng.choice(("article", "article", "main", "div", "div", "section"))
        bare = tag in ("article", "main") and rng.random() < 0.7
        core = f"<{tag}{'' if bare else ' ' + _named(rng, MAIN)}>{''.join(blocks)}</{tag}>"
        for _ in range(rng.randrange(3)):
            core = f"<{rng.choice(('div', 'main', 'section'))} class='{rng.choice(('wrap', 'container', 'row', 'col', 'page', 'site', 'inner'))}'>{core}</div>"
        before = [self.part(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.5]
        after = [self.part(k) for k in ("comment", "aside", "ad", "form", "nav", "notice", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        return f"<html><body>{''.join(before)}{core}{''.join(after)}</body></html>"


def _labels(nodes: list[Node], mine) -> np.ndarray:
    label = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].text is not None:
            label[i] = mine(nodes[i])
        if label[i] and nodes[i].parent >= 0:
            label[nodes[i].parent] = 1
    return label


def _article_leaves(nodes: list[Node]) -> set[int]:
    """Leaves that a page itself marks as its article, outside of parts marked as something else."""
    out = set()
    for i, node in enumerate(nodes):
        if node.text is None:
            continue
        tags, up = [], node.parent
        while up >= 0:
            tags.append(nodes[up].tag)
            if nodes[up].tokens and set(nodes[up].tokens) & {"ad", "ads", "advert", "sidebar", "comments", "comment", "menu"}:
                tags.append("aside")
            up = nodes[up].parent
        if ("article" in tags or "main" in tags) and not {"nav", "footer", "aside", "form", "header"} & set(tags):
            out.add(i)
    return out


def fit(pages: list[str], layouts: int = LAYOUTS, seed: int = 7) -> Model:
    """Trees from pages that mark their article, as they are and set in random other layouts with known labels."""
    rng = random.Random(seed)
    real = [(nodes, leaves) for nodes in map(parse, pages) if (leaves := _article_leaves(nodes))]
    articles = [[nodes[i].text for i in sorted(leaves)] for nodes, leaves in real] or [["A title", "Some words, and then some more of them.", "The end of it."]]
    samples = [(nodes, _labels(nodes, lambda n, own={id(nodes[i]) for i in leaves}: id(n) in own)) for nodes, leaves in real]
    others = [t for a in articles for t in a]
    for article in articles:
        for _ in range(layouts):
            nodes = parse(_Layout(rng, article[: 1 + rng.randrange(1, 25)], others).page())
            label = _labels(nodes, lambda n: _Layout.MARK in n.text)
            for n in nodes:
                if n.text is not None:
                    n.text = n.text.replace(_Layout.MARK, "")
            samples.append((nodes, label))
    counts: dict[str, int] = {}
    for nodes, _ in samples:
        for n in nodes:
            for t in n.tokens:
                counts[t] = counts.get(t, 0) + 1
    names = sorted((t for t, c in counts.items() if c >= 3), key=lambda t: (-counts[t], t))[:MAX_TOKENS]
    tokens = {t: i for i, t in enumerate(names)}
    x = np.concatenate([node_features(nodes, tokens) for nodes, _ in samples])
    y = np.concatenate([label for _, label in samples])
    return _narrowed(fit_trees(x, y), tokens)


def train(pages: DataFrame, n_pages: int = SAMPLE_PAGES) -> Model:
    """Fits on at most ``n_pages`` pages, by hash of their id, of ``SAMPLE_CHARS`` characters at most."""
    hashed = pages.where(F.length("html") <= SAMPLE_CHARS).select("html", F.xxhash64("page_id").alias("at"), F.xxhash64("html").alias("of"))
    # only hashes are ranked; the html of the few that are drawn is fetched by them
    drawn = hashed.select("at", "of").distinct().orderBy("at", "of").limit(n_pages)
    rows = hashed.join(F.broadcast(drawn), ["at", "of"]).groupBy("at", "of").agg(F.first("html").alias("html")).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: (r["at"], r["of"]))])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` as ``row`` with ``main_text``, the article of each page (``page_id, html``).

    Boosted trees score every block element and run of text of a page; the decoding keeps the
    likeliest set in which what is kept lies in kept elements only. Character references are decoded,
    white space in a block is one space, blocks are joined by two newlines in page order, and nothing
    is cut. Null or empty html, or a page without an article, gives an empty text. Repeated rows give
    equal texts. All columns stay in ``row``. The model is fitted on a bounded sample of the pages.
    """
    model = model or train(pages)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def extract(html_texts: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.texts(html_texts)), dtype=object)

    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    return row.select("row", extract(F.coalesce("row.html", F.lit(""))).alias("main_text"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_text": op6_html_text}
