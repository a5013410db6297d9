"""Byte-level BPE by a rank file: merges by a segment tree over byte positions, and decoding.

Pieces
    A text is split by the tokenizer's pattern; a piece that is a token as a
    whole is that token, any other starts as its single bytes.

Merges
    Of all neighbouring parts the pair whose bytes have the lowest rank is
    merged, of equal ones the leftmost, until no pair is a token.  A segment
    tree over the byte positions holds ``rank << 32 | position`` of the pair
    that begins at each position, so its root is the leftmost minimum.  A merge
    ends the life of one position and changes the pairs of the merged part and
    of the live part before it: three leaves, each a walk to the root.

    Pieces of at most ``WIDE`` bytes are merged side by side: pieces with trees
    of one size are one array, and a numpy step takes the next merge of each.
    A longer piece has a tree of its own, so its time grows with n log n.

Texts
    ``RankEncoder`` is ``tokens.Encoder`` with these merges in place of the
    library: distinct units of a batch are encoded once and remembered.

Characters
    What is a letter or a number depends on a library's version of Unicode.
    ``regex`` and tiktoken agree on all characters that Python's own tables
    assign; of later ones, tiktoken is asked for their kind.

Defined cases
    Null or empty text: no ids, which decode to no bytes; null ids likewise.
    Repeated rows and null doc_id: a row each.  Very long texts and pieces:
    whole.  Empty table: no rows.  Other columns are ignored.  Strings of
    special tokens are ordinary text.  An id outside the file is an error.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import gathered, small_batches
from .tokens import Encoder

#: Bytes of a piece up to which pieces are merged side by side, and positions of all their trees at a time.
WIDE, SIDE_BY_SIDE = 256, 1 << 19
#: So few pieces are merged one by one, and so many pieces a worker remembers.
FEW, MEMO_PIECES = 12, 100_000
NEVER = np.int64(np.iinfo(np.int64).max)


def default_ranks() -> str:
    """Path of the rank file that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Ranks:
    """A rank file: bytes of each token, and which pairs of tokens make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if any(bytes([i]) not in self.rank for i in range(256)):
            raise ValueError(f"{path} lacks single bytes")
        self.first = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.token: list[bytes | None] = [None] * (max(self.rank.values()) + 1)
        self.pair: dict[int, int] = {}
        for token, r in self.rank.items():
            self.token[r] = token
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = r
        order = sorted(self.pair)
        self._keys = np.array([*order, NEVER], np.int64)
        self._ranks = np.array([*(self.pair[k] for k in order), 0], np.int64)

    def leaves(self, a: np.ndarray, b: np.ndarray, position: np.ndarray) -> np.ndarray:
        """What the tree holds for the pairs of tokens a and b (negative: none) that begin at position."""
        key = (a << 32) | np.maximum(b, 0)
        at = np.searchsorted(self._keys, key)
        return np.where((self._keys[at] == key) & (b >= 0), (self._ranks[at] << 32) | position, NEVER)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Tokens of one piece."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    never, pair = int(NEVER), ranks.pair
    token = ranks.first[np.frombuffer(piece, np.uint8)]
    leaves = ranks.leaves(token, np.append(token[1:], -1), np.arange(n))
    rows = [np.append(leaves, np.full(width - n, NEVER))]
    while len(rows[-1]) > 1:
        rows.append(np.minimum(rows[-1][::2], rows[-1][1::2]))
    tree = [never, *np.concatenate(rows[::-1]).tolist()]  # node 1 is the root, node i has the children 2 i and 2 i + 1
    token, after, before = token.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(position: int) -> None:
        b = after[position]
        found = pair.get(token[position] << 32 | token[b]) if b < n else None
        update(position, never if found is None else found << 32 | position)

    def update(position: int, value: int) -> None:
        at = width + position
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            value = value if value < other else other
            at >>= 1
            if tree[at] == value:
                return
            tree[at] = value

    while tree[1] != never:
        rank, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        gone = after[at]
        token[at], token[gone] = rank, -1
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        update(gone, never)
        put(at)
        if before[at] >= 0:
            put(before[at])
    return [t for t in token if t >= 0]


def merge_together(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """Tokens of pieces whose trees have the same number of leaves."""
    m, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << int(sizes.max() - 1).bit_length()
    place = np.arange(width)
    inside = place < sizes[:, None]
    token = np.full((m, width + 1), -1, np.int64)  # the last column stands for what is beyond the end
    token[:, :width][inside] = ranks.first[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.minimum(np.tile(place + 1, (m, 1)), sizes[:, None])
    after = np.append(np.where(after == sizes[:, None], width, after), np.full((m, 1), width), axis=1)
    before = np.tile(np.arange(-1, width), (m, 1))
    tree = np.full((m, 2 * width), NEVER)
    tree[:, width:] = ranks.leaves(token[:, :width], np.append(token[:, 1:width], np.full((m, 1), -1), axis=1), np.broadcast_to(place, (m, width)))
    low = width
    while low > 1:
        tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
        low //= 2
    token_, after_, before_, tree_ = (x.reshape(-1) for x in (token, after, before, tree))
    rows = np.flatnonzero(tree[:, 1] != NEVER)
    while len(rows):
        root, links, nodes = tree[rows, 1], rows * (width + 1), rows * (2 * width)
        at = root & 0xFFFFFFFF
        gone = after_[links + at]
        follows = after_[links + gone]
        token_[links + at], token_[links + gone] = root >> 32, -1
        after_[links + at] = follows
        before_[links + follows] = at
        ahead = before_[links + at]
        has = ahead >= 0
        own, prior = ranks.leaves(root >> 32, token_[links + follows], at), ranks.leaves(token_[links + np.maximum(ahead, 0)], root >> 32, ahead)
        tree_[nodes + width + gone] = NEVER
        tree_[nodes + width + at] = own
        tree_[(nodes + width + ahead)[has]] = prior[has]
        walk = width + np.stack([gone, at, np.where(has, ahead, at)])
        while walk[0, 0] > 1:  # all leaves are equally deep
            walk >>= 1
            pair = nodes + 2 * walk
            tree_[nodes + walk] = np.minimum(tree_[pair], tree_[pair + 1])
        rows = rows[tree[rows, 1] != NEVER]
    live = token[:, :width] >= 0
    return np.split(token[:, :width][live], np.cumsum(live.sum(axis=1))[:-1])


def merge(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Tokens of non-empty pieces as little-endian unsigned 32-bit bytes."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        whole = ranks.rank.get(p)
        if whole is not None:
            out[i] = np.array([whole], "<u4").tobytes()
        elif len(p) > WIDE:
            out[i] = np.array(merge_one(p, ranks), "<u4").tobytes()
        else:
            by_width.setdefault((len(p) - 1).bit_length(), []).append(i)
    for bits, all_ in by_width.items():
        step = max(1, SIDE_BY_SIDE >> bits)
        for k in range(0, len(all_), step):
            own = all_[k : k + step]
            found = [merge_one(pieces[i], ranks) for i in own] if len(own) <= FEW else merge_together([pieces[i] for i in own], ranks)
            for i, x in zip(own, found, strict=True):
                out[i] = np.asarray(x, "<u4").tobytes()
    return out


# Characters ---------------------------------------------------------------


@cache
def late_characters() -> frozenset[str]:
    """Characters that ``regex`` calls letters or numbers and Python's tables don't assign."""
    late = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}]", late))


@cache
def stand_in(character: str) -> str:
    """A letter, digit or sign of the kind that tiktoken's own pattern takes a late character for."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {(x + character).encode(): 256 + i for i, x in enumerate("a1")}
    probe = tiktoken.Encoding("probe", pat_str=r"a\p{L}|1\p{N}|(?s:.)", mergeable_ranks=ranks, special_tokens={})
    return next((x for x in "a1" if len(probe.encode_ordinary(x + character)) == 1), "!")


def pieces_of(text: str, pattern: regex.Pattern) -> list[bytes]:
    """The UTF-8 matches of a pattern as tiktoken finds them."""
    if text.isascii() or late_characters().isdisjoint(text):
        return [p.encode() for p in pattern.findall(text)]
    alike = text.translate({ord(c): stand_in(c) for c in late_characters().intersection(text)})
    return [text[m.start() : m.end()].encode() for m in pattern.finditer(alike)]


# Texts --------------------------------------------------------------------


class RankEncoder(Encoder):
    """Ids by a rank file; no added tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern, self.added = Ranks(path), regex.compile(pattern), []
        self.n_bytes = np.array([len(t or b"") for t in self.ranks.token], np.int64)
        self.pieces: dict[bytes, bytes] = {}
        self._start(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool))

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes."""
        split = [pieces_of(t, self.pattern) for t in texts]
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        new = list({p for ps in split for p in ps} - self.pieces.keys())
        ids = dict(zip(new, merge(new, self.ranks), strict=True))
        out = [b"".join([ids[p] if p in ids else self.pieces[p] for p in ps]) for ps in split]
        self.pieces.update((p, x) for p, x in ids.items() if len(p) <= WIDE)
        return out

    def decode(self, ids: list[int]) -> bytes:
        try:
            return b"".join(map(self.ranks.token.__getitem__, ids))
        except (IndexError, TypeError):
            raise ValueError("an id isn't one of the file's") from None


_ENCODERS: dict[tuple[str, str], RankEncoder] = {}


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """The worker's own encoder, kept from task to task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = RankEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of each whole text."""
    small_batches(docs.sparkSession)

    def run(batches):
        own = rank_encoder(path, pattern)
        for batch in gathered(batches, 1):
            ids, ends = own.encode_flat(batch.column(1))
            offsets = pa.array(np.append(0, ends), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary) of rows with doc_id and ids."""

    def run(batches):
        own = rank_encoder(path, pattern)
        for batch in batches:
            texts = [b"" if not ids.is_valid else own.decode(ids.values.to_numpy(zero_copy_only=False).tolist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
