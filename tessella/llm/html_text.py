"""HTML extraction by a linear-chain conditional random field over leaf blocks.

Blocks
    A page is read once as a stream of tags and text.  Block-level tags end a
    leaf block, inline tags don't; a break or a run of white space inside a
    block is one space.  Scripts, styles, comments, hidden forms of text and
    markup declarations hold no text.  Unclosed paragraphs, list items and
    table cells end where HTML says.

Model
    Each block has features from its ancestors' tags and from class, id and
    role words of them, its own tag, its length, link and capital shares,
    punctuation, and whether ancestors are those of the block before it.  A
    linear-chain CRF with the labels "main text" and "other" is trained by
    gradient ascent on the penalised log-likelihood (forward-backward over all
    training pages at once) and decoded by Viterbi.  Labelled pages are made
    here: ``training_pages`` writes ``TRAINING_PAGES`` pages of many layouts
    with the label of each block.  No page of the corpus is needed, so the
    model is the same wherever it runs; its weights have a fixed size.

Defined cases
    Null or empty html, or no block of main text: empty text.  Plain text
    without markup: one block of its own, judged like others.  Repeated rows:
    one result each.  Null page_id or url stay null.  Empty table: no rows.
    Broken markup never fails.  Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import parts, small_batches

TRAINING_PAGES, SEED = 500, 11
DIM = 1 << 13
EXTRACTED = "page_id long, url string, text string, n_chars long"

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed xmp template".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl section article aside nav header footer main form body div td th select".split())

#: Where a search for tags that another tag closes has to look.
STOPS = SCOPES | {"p"} | frozenset().union(*CLOSES.values())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")


class Node:
    """An open block-level tag: what lies below it is read once and shared by the blocks inside.

    inside and marks are buckets of features, DIM at most however deep a page
    is nested; a node that adds none has its parent's.  Nodes with the same
    tags above them have the same trail.  barrier: the depth of the nearest
    tag, itself included, at which a search for tags to close has to look.
    """

    __slots__ = ("tag", "above", "inside", "marks", "trail", "barrier")

    def __init__(self, tag: str, above: "Node | None", marks: frozenset[str], barrier: int):
        self.tag, self.above, self.barrier = tag, above, barrier
        self.trail: dict = above.trail.setdefault(tag, {}) if above else {}
        self.inside = with_more(above.inside, (f"in={tag}",)) if above else NONE
        self.marks = with_more(above.marks, [f"mark={w}" for w in marks]) if above else NONE


class Block:
    __slots__ = ("text", "node", "marks", "links")

    def __init__(self, text: str, node: Node, marks: frozenset[int], links: int):
        self.text, self.node, self.marks, self.links = text, node, marks, links

    @property
    def path(self) -> tuple[str, ...]:
        """Tags of the ancestors, outermost first."""
        out, node = [], self.node
        while node.above:
            out.append(node.tag)
            node = node.above
        return tuple(out[::-1])


def with_more(buckets: frozenset[int], features: Iterable[str]) -> frozenset[int]:
    new = {bucket(f) for f in features} - buckets
    return buckets | new if new else buckets


def attribute_words(attributes: str) -> frozenset[str]:
    out: set[str] = set()
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if name.lower() in ("class", "id", "role", "itemprop"):
                out.update(WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
            elif name.lower() == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    out.add("hidden")
            elif value != "false":
                out.add("hidden")
    return frozenset(out)


NONE = frozenset()


class Stack:
    """The open tags of a page: nodes of block-level tags, and the inline tags open in the innermost.

    Every step takes time by the tags that it opens or closes, not by the depth.
    """

    def __init__(self):
        self.nodes = [Node("", None, NONE, 0)]
        self.open: Counter[str] = Counter()
        self.inline: dict[str, list[frozenset[str]]] = {}
        self.inline_marks: Counter[str] = Counter()

    def push(self, name: str, marks: frozenset[str]) -> None:
        above = self.nodes[-1]
        self.nodes.append(Node(name, above, marks, len(self.nodes) if name in STOPS else above.barrier))
        self.open[name] += 1

    def cut(self, depth: int) -> None:
        for node in self.nodes[depth:]:
            self.open[node.tag] -= 1
        del self.nodes[depth:]
        self.clear_inline()

    def clear_inline(self) -> None:
        if self.inline:
            self.inline.clear()
            self.inline_marks.clear()

    def open_inline(self, name: str, marks: frozenset[str]) -> None:
        self.inline.setdefault(name, []).append(marks)
        self.inline_marks.update(marks)

    def close(self, name: str) -> None:
        if name in INLINE:
            held = self.inline.get(name)
            if held:
                self.inline_marks.subtract(held.pop())
        elif self.open[name] > 0:
            depth = len(self.nodes) - 1
            while self.nodes[depth].tag != name:
                depth -= 1
            self.cut(depth)

    def close_for(self, name: str) -> None:
        """What a block-level tag of this name closes by itself."""
        depth = self.nodes[-1].barrier
        while depth:
            tag = self.nodes[depth].tag
            if tag == "p" or tag in CLOSES.get(name, ()):
                self.cut(depth)
            elif tag in SCOPES:
                break
            depth = self.nodes[depth - 1].barrier

    def marks(self) -> frozenset[int]:
        here = self.nodes[-1].marks
        return with_more(here, [f"mark={w}" for w, n in self.inline_marks.items() if n > 0]) if self.inline_marks else here


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in its order, those without text left out."""
    out: list[Block] = []
    stack = Stack()
    held: list[str] = []
    links = 0

    def end_block() -> None:
        nonlocal held, links
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append(Block(text, stack.nodes[-1], stack.marks(), min(links, len(text))))
            held, links = [], 0

    at, n = 0, len(page)
    find = TOKEN.search
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        m = find(page, lt) if lt < n else None
        if m is not None and m.start() != lt:  # "<" as plain text
            part = page[at : m.start()]
        else:
            part = page[at:lt]
        if m is None:
            part = page[at:]
        if part:
            held.append(part)
            if stack.inline.get("a"):
                links += len(part)
        if m is None:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name not in INLINE:
                end_block()
            stack.close(name)
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                held.append(" ")
            continue
        if name not in INLINE:
            end_block()
            stack.clear_inline()
            stack.close_for(name)
        if name in VOID or m.group(3).endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        marks = attribute_words(m.group(3)) if m.group(3) else NONE
        if name in INLINE:
            stack.open_inline(name, marks)
        else:
            stack.push(name, marks)
    end_block()
    return out


# Features -----------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def bucket(feature: str) -> int:
    h = 2166136261
    for b in feature.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % DIM


def features(blocks: list[Block]) -> list[list[int]]:
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        share = b.links / n
        names = ["bias", f"tag={b.node.tag}", f"long={n.bit_length()}", f"links={int(share * 4)}"]
        names.append("ends" if b.text[-1] in ".!?…。！？\"”»" else "open")
        names.append(f"commas={min(b.text.count(',') + b.text.count('، '), 3)}")
        names.append(f"shape={'copyright' if '©' in b.text or 'opyright' in b.text else 'plain'}")
        if i == 0:
            names.append("first")
        else:
            same = blocks[i - 1].node.trail is b.node.trail
            names.append("same" if same else "moved")
        if i == len(blocks) - 1:
            names.append("last")
        out.append([*map(bucket, names), *b.node.inside, *b.marks])
    return out


# Model --------------------------------------------------------------------


class Crf:
    """Linear chain with two labels; weights (DIM, 2), steps (2, 2)."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    @classmethod
    def train(cls, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 120, penalty: float = 0.02) -> "Crf":
        pages = [p for p in pages if p[0]]
        n, t = len(pages), max(len(p[0]) for p in pages)
        page, place, feature = (np.array(x) for x in zip(*[(i, j, f) for i, (fs, _) in enumerate(pages) for j, own in enumerate(fs) for f in own], strict=True))
        flat = page * t + place
        mask = np.zeros((n, t), bool)
        gold = np.zeros((n, t), int)
        for i, (fs, ys) in enumerate(pages):
            mask[i, : len(fs)] = True
            gold[i, : len(ys)] = ys
        one = np.eye(2)[gold] * mask[..., None]
        both = mask[:, 1:] & mask[:, :-1]
        w, s = np.zeros((DIM, 2)), np.zeros((2, 2))
        mean = [np.zeros_like(w), np.zeros_like(s)]
        square = [np.zeros_like(w), np.zeros_like(s)]
        add = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
        for step in range(1, rounds + 1):
            e = np.stack([np.bincount(flat, w[feature, k], minlength=n * t).reshape(n, t) for k in (0, 1)], axis=2)
            fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            fwd[:, 0] = e[:, 0]
            for j in range(1, t):
                fwd[:, j] = np.where(mask[:, j, None], e[:, j] + add(fwd[:, j - 1, :, None] + s, 1), fwd[:, j - 1])
            for j in range(t - 2, -1, -1):
                bwd[:, j] = np.where(mask[:, j + 1, None], add(s + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], 2), 0.0)
            z = add(fwd[:, -1], 1)
            node = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
            pair = np.exp(fwd[:, :-1, :, None] + s + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
            diff = (one - node).reshape(n * t, 2)
            gw = np.stack([np.bincount(feature, diff[flat, k], minlength=DIM) for k in (0, 1)], axis=1) - penalty * w
            gs = (one[:, :-1, :, None] * one[:, 1:, None, :]).sum((0, 1)) - pair.sum((0, 1)) - penalty * s
            for i, (x, g) in enumerate(((w, gw), (s, gs))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                x += 0.1 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
        return cls(w, s)

    def viterbi(self, blocks: list[list[int]]) -> list[int]:
        """The likeliest labels, 1 for main text."""
        if not blocks:
            return []
        w0, w1 = self.tables()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = sum(w0[f] for f in blocks[0]), sum(w1[f] for f in blocks[0])
        back = []
        for own in blocks[1:]:
            from_a = (a + s00 >= b + s10, a + s01 >= b + s11)
            back.append(from_a)
            a, b = (a + s00 if from_a[0] else b + s10) + sum([w0[f] for f in own]), (a + s01 if from_a[1] else b + s11) + sum([w1[f] for f in own])
        y = [0 if a >= b else 1]
        for from_a in reversed(back):
            y.append(0 if from_a[y[-1]] else 1)
        return y[::-1]

    def tables(self) -> tuple[list[float], list[float]]:
        if not hasattr(self, "_tables"):
            self._tables = (self.weights[:, 0].tolist(), self.weights[:, 1].tolist())
        return self._tables


# Labelled pages -----------------------------------------------------------


def training_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Pages of many layouts and the label of each of their leaf blocks.

    Whether a block is main text follows from the part of the page that it was
    written for; tags and words of attributes that such parts use are mixed.
    """
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an er in on".split()]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low=4, high=18):
        ws = [word() + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(low, high))]
        return " ".join(ws).capitalize().rstrip(",") + rng.choice("...!?")

    prose = lambda low=1, high=6: " ".join(sentence() for _ in range(rng.randint(low, high)))
    short = lambda low=1, high=4: " ".join(word() for _ in range(rng.randint(low, high)))
    pages = []
    for _ in range(n):
        out: list[str] = []
        labels: list[int] = []

        def put(markup: str, *ys: int) -> None:
            out.append(markup)
            labels.extend(ys)

        def attr(*words: str) -> str:
            r = rng.random()
            if r < 0.25 or not words:
                return ""
            return f' {rng.choice(["class", "class", "id", "role"])}="{rng.choice(words)}{rng.choice(["", "", "-wrap", "-box", " x1"])}"'

        def links(box: str, *words: str) -> None:
            k = rng.randint(2, 8)
            style = rng.random()
            mid = "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(k)) if style < 0.6 else "".join(f'<div><a href="#">{short()}</a></div>' for i in range(k))
            put(f"<{box}{attr(*words)}>" + (f"<ul>{mid}</ul>" if style < 0.6 else mid) + f"</{box}>", *[0] * k)

        def plain(box: str, words: tuple[str, ...], k: int, long: bool = False) -> None:
            inner = "".join(f"<p>{prose() if long or rng.random() < 0.4 else sentence(2, 9)}</p>" for _ in range(k))
            a = attr(*words)
            if box in ("div", "section", "ul") and not a:  # a plain box has to be named
                a = f' class="{rng.choice(words)}"'
            if rng.random() < 0.4:
                put(f"<{box}{a}>{sentence(2, 12)}</{box}>", 0)
            else:
                put(f"<{box}{a}>{inner}</{box}>", *[0] * k)

        if rng.random() < 0.6:
            links(rng.choice(["nav", "nav", "header"]), "nav", "menu", "navbar", "site-header", "top", "navigation")
        if rng.random() < 0.5:
            plain("header", ("header", "masthead", "banner", "site-header"), rng.randint(1, 2))
        for _ in range(rng.randint(0, 2)):
            kind = rng.random()
            if kind < 0.5:
                plain(rng.choice(["div", "div", "section", "aside"]), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad"), rng.randint(1, 3), rng.random() < 0.4)
            elif kind < 0.8:
                plain("div", ("notice", "cookie", "cookies", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall"), rng.randint(1, 2), rng.random() < 0.3)
            else:
                put(f'<form{attr("search", "login", "form")}><label>{short()}</label> <button>{short(1, 2)}</button></form>', *([0, 0]))
        # the article
        root = rng.choice(["article", "article", "article", "main", "div", "section"])
        a = attr("article", "post", "content", "entry", "story", "main", "body", "text")
        if root in ("div", "section") and not a:
            a = ' class="content"'
        wrap = rng.random() < 0.3
        put(("<main>" if wrap and root != "main" else "") + f"<{root}{a}>")
        if rng.random() < 0.9:
            put(f"<h1>{short(2, 10)}</h1>", 1)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.08:
                put(f"<h{rng.randint(2, 4)}>{short(1, 6)}</h2>", 1)
            elif kind < 0.13:
                k = rng.randint(1, 4)
                put("<ul>" + "".join(f"<li>{sentence(2, 10)}" for _ in range(k)) + "</ul>", *[1] * k)
            elif kind < 0.17:
                put(f"<blockquote>{prose(1, 2)}</blockquote>", 1)
            elif kind < 0.2:
                put(f"<pre>{short(3, 9)}</pre>", 1)
            elif kind < 0.23:
                put(f"<table><tr><td>{short()}<td>{short()}</table>", 1, 1)
            elif kind < 0.29:
                plain(rng.choice(["aside", "div"]), ("ad", "advert", "related", "share", "social", "promo", "newsletter", "pullquote-ad"), 1)
            else:
                text = prose() if rng.random() < 0.85 else short(1, 3) + "."
                if rng.random() < 0.3:
                    text = text.replace(" ", f' <a href="#">{word()}</a> ', 1)
                if rng.random() < 0.2:
                    text = f"<b>{text}<br>"
                put(f"<p>{text}" + ("</p>" if rng.random() < 0.8 else ""), 1)
        put(f"</{root}>" + ("</main>" if wrap and root != "main" else ""))
        # what follows it
        if rng.random() < 0.4:
            k = rng.randint(1, 4)
            tag = rng.choice(["p", "div", "li", "article"])
            put(f'<{rng.choice(["section", "div", "ol"])} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment", "comment-list", "discussion", "replies", "disqus", "responses"])}">' + "".join(f'<{tag}{attr("comment", "reply", "comment-body")}>{prose(1, 3)}</{tag}>' for _ in range(k)) + "</section></div></ol>", *[0] * k)
        if rng.random() < 0.4:
            box = rng.choice(["aside", "aside", "div"])
            words = ("sidebar", "related", "widget", "aside", "recommended", "share", "social", "tags", "breadcrumb", "trending")
            links(box, *words) if box == "aside" else plain(box, words, rng.randint(1, 3))
        if rng.random() < 0.8:
            if rng.random() < 0.5:
                links("footer", "footer", "site-footer", "bottom", "copyright")
            else:
                put(f'<footer{attr("footer", "site-footer")}>&copy; {short()} &middot; {sentence()}</footer>', 0)
        elif rng.random() < 0.5:
            plain("div", ("footer", "copyright", "legal", "disclaimer", "site-footer"), 1)
        page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join(out) + "</body></html>"
        pages.append((page, labels))
    return pages


@cache
def model() -> Crf:
    """The CRF trained on training_pages; the same on every call."""
    rows = []
    for page, labels in training_pages():
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            rows.append((features(blocks), labels))
    return Crf.train(rows)


def main_text(page: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b.text for b, y in zip(blocks, crf.viterbi(features(blocks)), strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    small_batches(pages.sparkSession)
    crf = model()
    weights, steps = crf.weights.astype(np.float64), crf.steps

    def run(batches):
        crf = Crf(weights, steps)
        for batch in batches:
            for own in parts(batch, 2):
                texts = [main_text(h, crf) for h in own.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, EXTRACTED)
