"""Main text of web pages by boosted trees over DOM nodes (operator 4).

A page becomes a tree of block elements. Every node has features: depth, tag, tokens of its class, id and role, density
of text and links in its subtree, its place among its siblings and their text. Gradient-boosted trees give it log-odds
of being main text. Decoding is hierarchical: going up the tree, a node takes the best of "all main text", "all chrome"
and "the best of my children", so a part of the page is never both inside and outside.

The trees learn from at most ``PAGES`` pages of at most ``LONGEST`` characters of the table itself, twice: as they are, where elements that mean main text
by the HTML standard label it, and taken apart and set again into page frames of many kinds, whose labels are known.
Every page is then read whole, by the task that holds it.

Defined results: a null page counts as empty; a page without main text gives an empty text; broken markup is read as far
as it goes; an empty table gives no rows; repeated rows give equal rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, table

PAGES, TREES, DEPTH, BINS, RATE, SWITCH = 200, 40, 4, 24, 0.25, 1.0
#: Characters of a page that the trees may learn from, and nodes of small pages that are scored together.
LONGEST, NODES = 200_000, 20_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr label".split())
UNSEEN = set("head script style template noscript svg math iframe object select option button textarea audio video canvas title".split())
#: Elements that may stand in a head; any other start tag and any text end it, as in the HTML standard.
HEAD = set("head html base basefont bgsound link meta title noscript noframes script style template".split())
#: Elements that a start tag of the same group ends.
ENDS = {t: {t} for t in ("p", "li", "tr", "option")} | {t: {"dt", "dd"} for t in ("dt", "dd")} | {t: {"td", "th"} for t in ("td", "th")}
KEEPS_P = INLINE | VOID - {"hr"}
TAGS = "html body div section article main p h1 h2 h3 li ul ol nav header footer aside form table td blockquote pre figure dl fieldset".split()
TOKENS = (
    "ad ads advert advertisement article aside author banner body breadcrumb byline comment comments complementary consent container content contentinfo cookie "
    "copyright disclaimer entry feedback footer form gdpr header layout legal links login main masthead menu meta modal nav navbar navigation newsletter notice page pagination "
    "popup post promo promoted related replies reply respond row search share sharing sidebar signup site skip social sponsor sponsored story subscribe tags text thread toc toolbar top "
    "discussion widget wrap wrapper"
).split()
NUMBERS = 18
WIDTH = NUMBERS + 2 * len(TAGS) + 2 * len(TOKENS)
TAG_AT, TOKEN_AT = {t: k for k, t in enumerate(TAGS)}, {t: k for k, t in enumerate(TOKENS)}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    label: int | None  # what the markup says of its text, for training
    chars: int = 0
    link_chars: int = 0
    stops: int = 0
    runs: int = 0
    kids: list[int] = field(default_factory=list)


class Tree(HTMLParser):
    """Block elements of a page, and its runs of text in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", -1, 0, [], None)]
        self.open: list[tuple[str, int]] = [("#page", 0)]
        # Places in ``open`` by tag, of blocks, and of blocks that are no paragraphs, so that no tag walks what is open.
        self.at: dict[str, list[int]] = {}
        self.blocks, self.walls = [0], [0]
        self.unseen = self.links = 0
        self.texts: list[tuple[int, str]] = []
        self.run: list[str] = []
        self.run_links = 0
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            k = self.open[-1][1]
            node = self.nodes[k]
            node.chars += len(text)
            node.link_chars += min(self.run_links, len(text))
            node.stops += sum(text.count(c) for c in ".,;:!?")
            node.runs += 1
            self.texts.append((k, text))
        self.run, self.run_links = [], 0

    def _pop(self) -> None:
        tag, _ = self.open[-1]
        if tag not in INLINE:
            self._flush()
            self.blocks.pop()
            if tag != "p":
                self.walls.pop()
        self.at[tag].pop()
        self.open.pop()
        self.unseen -= tag in UNSEEN
        self.links -= tag == "a"

    def _push(self, tag: str, node: int) -> None:
        place = len(self.open)
        self.at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
            if tag != "p":
                self.walls.append(place)
        self.open.append((tag, node))

    def _end_head(self) -> None:
        while self.open[-1][0] == "head":
            self._pop()

    def handle_starttag(self, tag: str, attrs) -> None:
        inline = tag in INLINE
        if tag not in HEAD:
            self._end_head()
        if tag == "br":
            self.run.append(" ")
        if tag in VOID:
            if not inline:
                self._flush()
            return
        # The nearest open element that this tag ends, unless a block other than a paragraph stands above it.
        ended = ENDS.get(tag) or (set() if tag in KEEPS_P else {"p"})
        last = max((self.at[t][-1] for t in ended if self.at.get(t)), default=0)
        if last and last >= self.walls[-1]:
            while len(self.open) > last:
                self._pop()
        if tag == "body":  # a head that was never closed
            while self.unseen:
                self._pop()
        if not inline:
            self._flush()
        parent = self.open[-1][1]
        if inline:
            self._push(tag, parent)
        else:
            held = dict(attrs)
            said = " ".join(str(held.get(a) or "") for a in ("class", "id", "role"))
            said = re.sub(r"([a-z])([A-Z])", r"\1 \2", said)
            tokens = re.findall("[a-z]+", said.lower())
            label = self.nodes[parent].label
            if "data-y" in held:
                label = int(held["data-y"])
            elif tag in ("article", "main") and label is None:
                label = 1
            elif tag in ("nav", "aside", "footer", "form") and label is not None:
                label = 0
            self.nodes.append(Node(tag, parent, self.nodes[parent].depth + 1, tokens, label))
            self.nodes[parent].kids.append(len(self.nodes) - 1)
            self._push(tag, len(self.nodes) - 1)
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        places = self.at.get(tag)
        if places and not (tag in INLINE and self.blocks[-1] > places[-1]):
            last = places[-1]
            while len(self.open) > last:
                self._pop()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.unseen:
            self.run.append(data)
            if self.links:
                self.run_links += len(data.strip())

    def features(self) -> np.ndarray:
        nodes = self.nodes
        n = len(nodes)
        own = np.array([(x.chars, x.link_chars, x.stops, x.runs, 1, x.tag == "p", x.tag in ("input", "li")) for x in nodes], float)
        total = own.copy()
        for k in range(n - 1, 0, -1):  # children come after their parents
            total[nodes[k].parent] += total[k]
        chars, links, stops, runs, size, paragraphs, items = total.T
        parent = np.array([max(x.parent, 0) for x in nodes])
        kids = np.array([len(x.kids) for x in nodes], float)
        place = np.zeros(n)
        for x in nodes:
            for i, k in enumerate(x.kids):
                place[k] = i
        siblings = np.maximum(kids[parent], 1)
        per = lambda a, b: a / np.maximum(b, 1)
        beside = np.maximum(chars[parent] - chars, 0)
        numbers = np.stack(
            [
                np.array([x.depth for x in nodes], float), np.log1p(chars), np.log1p(own[:, 0]), per(links, chars), per(stops, chars), np.log1p(per(chars, size)), np.log1p(per(chars, runs)),
                np.log1p(size), np.log1p(paragraphs), per(items, size), kids, place, place / siblings, np.log1p(siblings), per(chars, chars[parent]), per(chars, chars[0]),
                per(links[parent] - links, beside), np.log1p(per(beside, siblings - 1)),
            ],
            1,
        )
        out = np.zeros((n, WIDTH), np.float32)
        out[:, :NUMBERS] = numbers
        # Of the node itself and of the nearest node above it.
        for k, x in enumerate(nodes):
            if (t := TAG_AT.get(x.tag)) is not None:
                out[k, NUMBERS + t] = 1
            for w in x.tokens:
                if (t := TOKEN_AT.get(w)) is not None:
                    out[k, NUMBERS + 2 * len(TAGS) + t] = 1
            if k:
                up = out[x.parent]
                out[k, NUMBERS + len(TAGS) : NUMBERS + 2 * len(TAGS)] = up[NUMBERS : NUMBERS + len(TAGS)]
                at = NUMBERS + 2 * len(TAGS) + len(TOKENS)
                out[k, at:] = np.maximum(up[at - len(TOKENS) : at], up[at:])
        return out

    def decode(self, odds: np.ndarray) -> str:
        """The main text: each node all in, all out, or as its children are best."""
        n = len(self.nodes)
        # What each node's own text says, and what its subtree says as one.
        own = np.array([odds[k] * np.log1p(x.chars) for k, x in enumerate(self.nodes)])
        whole, best, mixed = own.copy(), np.abs(own), np.zeros(n, bool)
        below = np.zeros(n)
        for k in range(n - 1, -1, -1):
            apart = abs(own[k]) + below[k] - SWITCH
            mixed[k] = bool(self.nodes[k].kids) and apart > abs(whole[k])
            best[k] = max(apart, abs(whole[k])) if self.nodes[k].kids else abs(whole[k])
            if k:
                whole[self.nodes[k].parent] += whole[k]
                below[self.nodes[k].parent] += best[k]
        inside = np.zeros(n, bool)
        settled = np.zeros(n, bool)
        for k, x in enumerate(self.nodes):
            if k and settled[x.parent]:
                settled[k], inside[k] = True, inside[x.parent]
            elif mixed[k]:
                inside[k] = own[k] > 0
            else:
                settled[k], inside[k] = True, whole[k] > 0
        return "\n".join(t for k, t in self.texts if inside[k])


@dataclass
class Boosted:
    """Trees of equal depth: features and cuts by node in breadth-first order, then leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Second-order boosting of the logistic loss over histograms."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(d)]
    codes = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(d)], 1)
    flat = codes + np.arange(d) * BINS
    share = np.clip(np.average(y, weights=weight), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    odds = np.full(n, base)
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, int)
        feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (d * BINS) + flat).ravel()
            hist = lambda v: np.bincount(key, np.repeat(v, d), width * d * BINS).reshape(width, d, BINS)
            gl, hl = hist(g).cumsum(2), hist(h).cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            for k in range(width):
                f, b = np.unravel_index(int(gain[k].argmax()), (d, BINS))
                if gain[k, f, b] > 1e-3 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        at -= 2**DEPTH - 1
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        odds += leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Boosted(np.array(features), np.array(cuts), np.array(leaves), base)


# Frames for training pages: names that pages give to their parts.
CHROME = {
    "nav": ["nav", "div.menu", "div.nav", "ul.navigation", "div.breadcrumb", "div.toolbar", "div.pagination", "div.toc"],
    "head": ["header", "div.header", "div.masthead", "div.site-header", "div.banner", "div#top"],
    "foot": ["footer", "div.footer", "div#footer", "div.copyright", "div.legal", "section.disclaimer"],
    "side": ["aside", "div.sidebar", "div.widget", "div.related", "aside.promo", "section.related-links", "div.promoted", "div.tags"],
    "note": ["div.cookie-notice", "div.notice", "div#consent", "div.gdpr-banner", "div.popup", "div.modal", "div.subscribe", "div.newsletter"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "section.sponsor", "aside.ad"],
    "talk": ["section.comments", "div.comments", "div#comments", "div.comment-list", "div.replies", "div.discussion", "section.thread", "div#respond", "div.feedback"],
    "form": ["form", "form.search", "form.login", "form.signup", "div.form"],
    "share": ["div.share", "div.social", "ul.sharing", "div.meta"],
}
MAIN = ["article", "main", "div.content", "div.article", "div.post", "div.entry-content", "section.story", "div#main", "div.post-body", "div.text", "main.content", "article.post", "div"]
WRAP = ["div.wrapper", "div.container", "div.page", "div#content", "section", "div.row", "div.layout", "main", "div"]


def _element(name: str, inner: str, y: int | None = None) -> str:
    tag, kind, said = re.match(r"(\w+)([.#]?)(.*)", name).groups()
    attr = f' {"class" if kind == "." else "id"}="{said}"' if kind else ""
    return f"<{tag}{attr}{'' if y is None else f' data-y={y}'}>{inner}</{tag}>"


def reframed(texts: list[str], rng: np.random.Generator) -> str:
    """A page of the given paragraphs within frames drawn at random."""
    pick = lambda a: a[int(rng.integers(len(a)))]
    words = " ".join(texts).split() or ["text"]

    def some(n: int) -> str:
        at = int(rng.integers(max(1, len(words) - n)))
        return " ".join(words[at : at + n])

    def links(n: int) -> str:
        item = pick(["<li><a href=#>{}</a></li>", "<a href=#>{}</a> ", "<p><a href=#>{}</a></p>"])
        inner = "".join(item.format(some(int(rng.integers(1, 4)))) for _ in range(n))
        return f"<ul>{inner}</ul>" if item.startswith("<li") else inner

    def part(kind: str) -> str:
        if kind == "talk":
            one = pick(["article.comment", "div.comment", "li.comment", "div.reply"])
            inner = "<h3>" + some(2) + "</h3>" + "".join(_element(one, f"<p>{some(int(rng.integers(3, 60)))}</p>") for _ in range(int(rng.integers(1, 6))))
        elif kind in ("nav", "share"):
            inner = links(int(rng.integers(2, 10)))
        elif kind == "form":
            inner = f"<label>{some(3)}</label><input name=q>{some(int(rng.integers(1, 12)))}<button>{some(1)}</button>"
        elif kind == "side":
            inner = pick([f"<h3>{some(2)}</h3>" + links(4), f"<p>{some(int(rng.integers(5, 60)))}</p>"])
        else:
            inner = pick([some(int(rng.integers(3, 40))), f"<p>{some(int(rng.integers(3, 40)))}</p>", links(3) + some(6)])
        return _element(pick(CHROME[kind]), inner, 0)

    chosen = lambda kinds, p: [part(k) for k in kinds if rng.random() < p]
    body = [_element(pick(["h1", "h2"]), some(6))] if rng.random() < 0.7 else []
    for t in texts:
        body.append(pick(["<p>{}</p>"] * 8 + ["<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<p><b>{}</b><br>", "<pre>{}</pre>", "<div>{}</div>"]).format(t))
        if rng.random() < 0.06:
            body.append(part(pick(["ad", "share", "side", "note"])))
    main = _element(pick(MAIN), "".join(body + chosen(["share", "talk"], 0.15)), 1)
    middle = [*chosen(["side", "ad"], 0.3), main, *chosen(["talk", "side", "ad", "share", "form"], 0.35)]
    inner = "".join(middle)
    for _ in range(int(rng.integers(0, 3))):
        inner = _element(pick(WRAP), inner, 0)
    return f"<html><body>{''.join(chosen(['note', 'head', 'nav', 'ad', 'form'], 0.45))}{inner}{''.join(chosen(['foot', 'note', 'nav'], 0.5))}</body></html>"


def _labelled(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and weight of the nodes of a training page; a node is main text if most of its characters are."""
    nodes = tree.nodes
    good, every = np.zeros(len(nodes)), np.zeros(len(nodes))
    for k in range(len(nodes) - 1, -1, -1):
        good[k] += nodes[k].chars * (nodes[k].label == 1)
        every[k] += nodes[k].chars
        if k:
            good[nodes[k].parent] += good[k]
            every[nodes[k].parent] += every[k]
    weight = np.where(every > 0, np.abs(2 * good / np.maximum(every, 1) - 1), 0)
    return tree.features(), (2 * good > every).astype(float), weight


def fit(pages: DataFrame, html_col="html", rows: int = PAGES) -> Boosted | None:
    """Trees from at most ``rows`` pages, the first by a hash; features are made in tasks, and as many rows reach the driver."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for html in batch.html:
                tree = Tree(html)
                rng = np.random.default_rng(len(html))
                main = [t for k, t in tree.texts if tree.nodes[k].label == 1] or [t for _, t in tree.texts]
                held = [_labelled(Tree(reframed(main[: int(rng.integers(1, 30))], rng))) for _ in range(3)]
                if any(x.label == 1 for x in tree.nodes):
                    held.append(_labelled(tree))
                x, y, w = (np.concatenate(a).astype("<f4") for a in zip(*held))
                yield pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()], "w": [w.tobytes()]})

    some = pages.select(F.col(html_col).alias("html")).where((F.col("html") != "") & (F.length("html") <= LONGEST)).orderBy(F.xxhash64("html")).limit(rows)
    got = some.mapInPandas(task, "x binary, y binary, w binary").toPandas()
    if not len(got):
        return None
    x, y, w = (np.frombuffer(b"".join(got[c]), "<f4") for c in ("x", "y", "w"))
    x, use = x.reshape(-1, WIDTH), w > 0
    order = np.lexsort(x[use].T[:4])
    return boost(x[use][order], y[use][order].astype(float), w[use][order].astype(float))


def main_text(pages: DataFrame, model: Boosted | None, html_col="html", keep=("page_id", "url")) -> DataFrame:
    """``keep`` and text of every page."""
    arrow_batches(pages.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            trees: list[Tree] = []
            pages_left = batch.num_rows
            for html in batch.column("html").to_pylist() if model is not None else ():
                trees.append(Tree(html))
                pages_left -= 1
                if pages_left and sum(len(t.nodes) for t in trees) < NODES:
                    continue
                odds, at = model.odds(np.concatenate([t.features() for t in trees])), 0
                for t in trees:
                    texts.append(t.decode(odds[at : at + len(t.nodes)]))
                    at += len(t.nodes)
                trees = []
            texts = texts if model is not None else [""] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    rows = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = rows.select(*keep).withColumn("text", F.lit("")).schema
    return rows.mapInArrow(task, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    pages = table(spark, sf_dir, "pages")
    arrow_batches(spark)
    return main_text(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
