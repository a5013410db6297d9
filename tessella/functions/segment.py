"""Words of text without blanks by a dictionary, and token counts by a vocabulary."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: What is cut by the dictionary, and what else is a token: runs of other letters and digits, other signs one by one.
HAN_RUN = r"[⺀-⿟々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003FFFF]+"
#: Words that a dictionary may have, as it travels to every task, and cut pieces that a task remembers.
MAX_WORDS, MEMO = 1_000_000, 100_000
#: Words that a task holds as Python strings at a time, besides those it remembers.
WORD_SLICE = 200_000


class Lattice:
    """A dictionary as a prefix tree, and the most probable way through a run of characters.

    A word's probability is its count in the dictionary's total; a character
    that begins no word counts as a word seen once.  Of equally probable ways
    the one with the longer word first wins.
    """

    def __init__(self, counts: dict[str, int]):
        if len(counts) > MAX_WORDS:
            raise ValueError(f"a dictionary of more than {MAX_WORDS} words")
        self.tree: dict = {}
        self.known: dict[str, list[str]] = {}
        total = math.log(max(1, sum(counts.values())))
        self.unseen = -total
        for word, n in counts.items():
            node = self.tree
            for c in word:
                node = node.setdefault(c, {})
            node[""] = math.log(max(n, 1)) - total

    def words_from(self, run: str, at: int):
        """(end, log probability) of each word that begins at a place."""
        node, single = self.tree, False
        for end in range(at, len(run)):
            node = node.get(run[end])
            if node is None:
                break
            if "" in node:
                single = single or end == at
                yield end + 1, node[""]
        if not single:
            yield at + 1, self.unseen

    def cut(self, run: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
        for at in range(len(run) - 1, -1, -1):
            best[at] = max((p + best[end][0], end) for end, p in self.words_from(run, at))
        out, at = [], 0
        while at < len(run):
            out.append(run[at : best[at][1]])
            at = best[at][1]
        return out


def segmenter(counts: dict[str, int], run: str = HAN_RUN) -> Callable[[Column], Column]:
    """A tokenizer for ``retrieval.bm25`` and ``document_frequencies``: array<string> of a text (null: null).

    What run matches is cut by the dictionary; the rest as the default does.
    A task cuts equal pieces once, as long as it remembers them.
    """
    lattice = Lattice(counts)
    parts = re.compile(rf"({run})|[^\W_]+|[^\w\s]|_")
    inside = re.compile(run)

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        known = lattice.known
        # a batch's words pass into Arrow some at a time, its texts one by one
        flat, done, ends, nulls = [], [pa.array([], pa.string())], [0], []
        for scalar in texts:
            text = scalar.as_py()
            for m in parts.finditer(text or ""):
                piece = m[0]
                words = known.get(piece)
                if words is None:
                    if len(known) >= MEMO:
                        known.clear()
                    words = known[piece] = [piece] if m[1] is None and not inside.search(piece) else [w for i, part in enumerate(re.split(rf"({run})", piece)) if part for w in (lattice.cut(part) if i % 2 else [part])]
                flat += words
            if len(flat) >= WORD_SLICE:
                done.append(pa.array(flat, pa.string()))
                flat = []
            ends.append(sum(map(len, done)) + len(flat))
            nulls.append(text is None)
        words = pa.concat_arrays([*done, pa.array(flat, pa.string())])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words, mask=pa.array(nulls, pa.bool_()))

    return tokens


def dictionary(words: DataFrame, word: str = "word", count: str = "n") -> dict[str, int]:
    """A dictionary from a table of words, refused beyond MAX_WORDS."""
    rows = words.where(F.col(word) != "").groupBy(word).agg(F.sum(count).alias("n")).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a dictionary of more than {MAX_WORDS} words")
    return {r[word]: int(r["n"]) for r in rows}


class VocabularyCounter:
    """How many tokens of a public tokenizer's file a text has; for ``chunking.chunks`` in place of the estimate.

    The file is read where it is first needed, so a counter travels as a path.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        return len(_tokenizer(self.path).encode(text, add_special_tokens=False).ids)


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]
