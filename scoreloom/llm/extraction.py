"""Main-text extraction by sum-product message passing over the DOM tree."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.columns import apart
from scoreloom.llm.dom import Node, attributes_of, read_html
from scoreloom.llm.labelled_pages import labelled_pages

# Words in class, id and role that hint at what a block is.
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pager pagination toc skip",
    "side": "sidebar side aside widget widgets rail related recommended recommendation popular trending more complementary",
    "foot": "footer foot copyright legal colophon bottom contentinfo",
    "head": "header masthead topbar logo branding top banner",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense outbrain taboola",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay newsletter subscribe subscription signup paywall disclaimer message warning dialog toast",
    "comment": "comment comments disqus reply replies discussion respond responses reader readers feedback thread",
    "share": "share sharing social follow tweet facebook like",
    "form": "form search searchbox login contact input register poll survey",
    "content": "article content post entry story body main text prose hentry page single maincontent articlebody",
    "meta": "meta byline author date time tags tag category categories info credits",
    "hidden": "hidden hide invisible sr",
}
# Words in a run of text that hint at what it belongs to.
SAYS = {
    "notice": "subscribe subscribers newsletter newsletters cookie cookies consent inbox unsubscribe signup gdpr",
    "foot": "copyright reserved privacy terms imprint impressum",
    "comment": "comment comments commented reply replies discussion",
    "related": "related popular recommended trending",
    "ad": "advertisement advertisements sponsored sponsor promoted buy shop",
    "share": "share tweet follow facebook",
    "nav": "home about contact menu login search",
}
SAYS_OF = {word: group for group, words in SAYS.items() for word in words.split()}
HINT_OF = {word: group for group, words in HINTS.items() for word in words.split()}
LONG_HINTS = sorted((w for w in HINT_OF if len(w) >= 6), key=lambda w: (-len(w), w))
KINDS = {"root": "#root html body", "text": "#text", "article": "article main", "side": "nav aside footer", "head": "header hgroup", "form": "form fieldset label legend search dialog", "list": "ul ol menu dir dl", "item": "li dd dt", "heading": "h1 h2 h3 h4 h5 h6", "para": "p blockquote pre", "table": "table caption tbody tfoot thead tr td th"}
KIND_OF = {tag: i + 1 for i, tags in enumerate(KINDS.values()) for tag in tags.split()}
N_KINDS = len(KINDS) + 1
LETTERS = re.compile("[a-z]+")
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SLOTS: dict[str, int] = {}
N_SLOTS = 256


@lru_cache(maxsize=65536)
def hint_of(word: str) -> str | None:
    """The group of a word, or of a long hint that it starts or ends with (``commentlist``)."""
    if word in HINT_OF or len(word) > 40:
        return HINT_OF.get(word)
    return next((HINT_OF[h] for h in LONG_HINTS if word.startswith(h) or word.endswith(h)), None)


def _slot(name: str) -> int:
    return SLOTS.setdefault(name, len(SLOTS))


for _name in ["bias", *[f"tag:{t}" for t in sorted(KIND_OF)], "tag:other", *[f"hint:{g}" for g in HINTS], *[f"role:{g}" for g in HINTS], *[f"len:{i}" for i in range(8)], *[f"link:{i}" for i in range(4)], *[f"in:{i}:{j}" for i in range(4) for j in range(3)], "ends", "commas", "sign", "place:first", "place:last", *[f"says:{g}:{size}" for g in SAYS for size in ("short", "long")], *[f"holds:{i}" for i in range(4)], "beside:before", "beside:after", "beside:both"]:
    _slot(_name)
assert len(SLOTS) <= N_SLOTS


def _features(node: Node, i: int, n: int, inside: tuple[int, int], page: int) -> list[int]:
    """Slots of a node's features; ``inside`` has the characters of text and of linked text below it, ``page`` the page's unlinked ones."""
    out = [SLOTS["bias"], SLOTS.get(f"tag:{node.tag}", SLOTS["tag:other"])]
    chars, linked = inside
    share = linked / chars if chars else 0.0
    rate = 0 if share < 0.05 else 1 if share < 0.35 else 2 if share < 0.75 else 3
    if node.tag == "#text":
        words = node.text.count(" ") + 1
        out += [SLOTS[f"len:{min(7, words.bit_length())}"], SLOTS[f"link:{rate}"]]
        if node.text[-1] in ".!?…。":
            out.append(SLOTS["ends"])
        if "," in node.text:
            out.append(SLOTS["commas"])
        if "©" in node.text or "®" in node.text:
            out.append(SLOTS["sign"])
        if words <= 40:
            size = "short" if words <= 6 else "long"
            out += [SLOTS[f"says:{g}:{size}"] for g in {SAYS_OF.get(w) for w in LETTERS.findall(node.text.lower())} - {None}]
    else:
        out.append(SLOTS[f"in:{rate}:{0 if chars < 80 else 1 if chars < 600 else 2}"])
        held = (chars - linked) / page if page else 0.0
        out.append(SLOTS[f"holds:{0 if held < 0.02 else 1 if held < 0.15 else 2 if held < 0.5 else 3}"])
        if node.attributes:
            given = attributes_of(node.attributes)
            seen = {hint_of(w) for k in ("class", "id") for w in map(str.lower, SPLIT.findall(given.get(k, "")))} - {None}
            if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
                seen.add("hidden")
            out += [SLOTS[f"hint:{g}"] for g in seen]
            out += [SLOTS[f"role:{HINT_OF[w]}"] for w in SPLIT.findall(given.get("role", "").lower()) if w in HINT_OF]
    if i < 0.1 * n:
        out.append(SLOTS["place:first"])
    elif i > 0.9 * n:
        out.append(SLOTS["place:last"])
    return out


def _beside_prose(nodes: list[Node]) -> list[str | None]:
    """For each element, whether the block before it, the one after it, or both, within the same parent, have a run of prose of their own."""
    prose = [bool(x.text) and is_prose(x) for x in nodes]
    for i, x in enumerate(nodes):
        if x.tag == "#text" and prose[i]:
            prose[x.parent] = True
    last: dict[int, int] = {}
    before, after = [False] * len(nodes), [False] * len(nodes)
    for i, x in enumerate(nodes):
        if i and x.parent in last:
            before[i], after[last[x.parent]] = prose[last[x.parent]], prose[i]
        last[x.parent] = i
    return ["both" if a and b else "before" if b else "after" if a else None for b, a in zip(before, after)]


def is_prose(node: Node) -> bool:
    """A run of ten words or more, hardly linked, with the marks of sentences."""
    return node.text.count(" ") >= 9 and 2 * node.linked <= len(node.text) and any(mark in node.text for mark in ".!?…。")


class Forest:
    """The trees of many pages as flat arrays, with their nodes grouped by depth."""

    def __init__(self, pages: list[list[Node]]):
        parent, depth, kind, slot, owner, base = [], [], [], [], [], 0
        self.start = [0]
        for nodes in pages:
            n = len(nodes)
            chars, linked = [len(x.text) for x in nodes], [x.linked for x in nodes]
            for i in range(n - 1, 0, -1):
                chars[nodes[i].parent] += chars[i]
                linked[nodes[i].parent] += linked[i]
            beside = _beside_prose(nodes)
            for i, node in enumerate(nodes):
                found = _features(node, i, n, (chars[i], linked[i]), chars[0] - linked[0])
                if beside[i] and node.tag != "#text":
                    found.append(SLOTS[f"beside:{beside[i]}"])
                slot += found
                owner += [base + i] * len(found)
                parent.append(base + node.parent if i else -1)
                depth.append(node.depth)
                kind.append(KIND_OF.get(node.tag, 0))
            base += n
            self.start.append(base)
        self.n = base
        self.parent, depth = np.array(parent, np.int64), np.array(depth)
        kind = np.array(kind)
        self.edge = kind[self.parent] * N_KINDS + kind
        self.slot, self.owner = np.array(slot), np.array(owner)
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(1, (depth.max() if base else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]  # below the roots, top down

    def marginals(self, weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of content for each node, with those before the downward message and of the parent without the node.

        ``ties[edge, p, c]`` are the potentials of a parent in state p and a
        child in state c. Messages are log-odds: first from the leaves up,
        then from the roots down.
        """
        own = np.bincount(self.owner, weights[self.slot], minlength=self.n)
        t = ties[self.edge]
        up = np.zeros(self.n)
        for level in reversed(self.levels):
            b = own[level]
            k = t[level]
            up[level] = np.logaddexp(k[:, 1, 0], k[:, 1, 1] + b) - np.logaddexp(k[:, 0, 0], k[:, 0, 1] + b)
            np.add.at(own, self.parent[level], up[level])
        out, rest = own.copy(), np.zeros(self.n)
        for level in self.levels:
            g = out[self.parent[level]] - up[level]
            k = t[level]
            out[level] += np.logaddexp(k[:, 0, 1], k[:, 1, 1] + g) - np.logaddexp(k[:, 0, 0], k[:, 1, 0] + g)
            rest[level] = g
        return out, own, rest


@dataclass(frozen=True)
class TreeModel:
    """Node weights and parent-child potentials."""

    weights: np.ndarray
    ties: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(pages: list[list[Node]], steps: int = 200, rate: float = 0.1, ridge: float = 2e-3) -> TreeModel:
    """Maximise the likelihood of the marked labels; the sum-product marginals give its gradient.

    An element counts as content when it holds a marked text.
    """
    forest = Forest(pages)
    y = np.concatenate([[float(x.mark) for x in nodes] for nodes in pages])
    for level in reversed(forest.levels):
        np.maximum.at(y, forest.parent[level], y[level])
    child = np.concatenate(forest.levels)
    edge, parent = forest.edge[child], forest.parent[child]
    seen = np.zeros((N_KINDS * N_KINDS, 2, 2))
    np.add.at(seen, (edge, y[parent].astype(int), y[child].astype(int)), 1)
    had = np.bincount(forest.slot, y[forest.owner], minlength=N_SLOTS)
    x = np.zeros(N_SLOTS + seen.size)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        weights, ties = x[:N_SLOTS], x[N_SLOTS:].reshape(seen.shape)
        out, below, rest = forest.marginals(weights, ties)
        p = _sigmoid(out)
        joint = ties[edge] + rest[child][:, None, None] * np.array([0, 1])[None, :, None] + below[child][:, None, None] * np.array([0, 1])[None, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected = np.zeros_like(seen)
        np.add.at(expected, edge, joint)
        g = np.concatenate([had - np.bincount(forest.slot, p[forest.owner], minlength=N_SLOTS), (seen - expected).ravel()]) / len(pages) - ridge * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return TreeModel(x[:N_SLOTS], x[N_SLOTS:].reshape(seen.shape))


@lru_cache(maxsize=4)
def page_model(pages: int = 800, seed: int = 3) -> TreeModel:
    """Trained on ``pages`` labelled pages; the same each time."""
    return train(labelled_pages(pages, seed))


def chosen(tree: list[Node], odds: np.ndarray) -> list[str]:
    """The runs with a marginal of one half or more; if none has, but some are prose, those hardly less likely than the likeliest prose."""
    least = 0.0
    if not any(x.text and z >= 0 for x, z in zip(tree, odds, strict=True)):
        prose = [z for x, z in zip(tree, odds, strict=True) if x.text and is_prose(x)]
        least = max(prose) - 1.0 if prose else 0.0
    return [x.text for x, z in zip(tree, odds, strict=True) if x.text and z >= least]


def main_texts(pages: list[str | None], model: TreeModel) -> list[str]:
    """The texts of the runs that are content (``chosen``), in page order, joined by a space."""
    trees = [read_html(p or "") for p in pages]
    out, at = [], 0
    while at < len(trees):
        end, nodes = at, 0
        while end < len(trees) and (end == at or nodes + len(trees[end]) <= 20_000):
            nodes += len(trees[end])
            end += 1
        forest = Forest(trees[at:end])
        odds, _, _ = forest.marginals(model.weights, model.ties)
        for k, tree in enumerate(trees[at:end]):
            own = odds[forest.start[k] : forest.start[k + 1]]
            out.append(" ".join(chosen(tree, own)))
        at = end
    return out


def extracted(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of each page; null and empty pages have an empty text.

    Pages are read one by one, so repeated rows get the same text each, and
    an empty table gives no rows. A column that is called ``name`` already is
    kept as ``_name``; other columns are not looked at.

    Map-only: pages go to Python in Arrow batches and are read there in runs
    of 256 KB, so a task holds one run of trees (or one very long page).
    """
    shared = pages.sparkSession.sparkContext.broadcast(page_model())

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        out, run, size = [], [], 0
        for x in column:
            run.append(x.as_py())
            size += len(run[-1] or "")
            if size > 1 << 18:
                out += main_texts(run, shared.value)
                run, size = [], 0
        return pa.array(out + main_texts(run, shared.value), pa.string())

    return pages.select(*apart(pages, name), text(F.col(html)).alias(name))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
