"""Token ids of whole texts by a public tokenizer file.

``Encoder`` returns exactly the ids of ``Tokenizer.encode(text,
add_special_tokens=False)``.  The byte-level pre-tokenizer always starts a new
piece at a single blank between two characters that are not white space, so a
text may be cut there, each unit encoded once by the library and remembered.
Where white space is irregular, units are joined until the cut is safe again.

Arrow cuts a batch of texts and numbers its distinct units; only those are
looked up or learned, and the ids of all texts are gathered in one piece.  An
unknown unit of ordinary letters, digits and signs is put together of the
pre-tokenizer's pieces ("word" and ","), so that only new pieces are learned.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
#: Units and ids that a worker remembers, and the longest unit that stays.
MEMO_UNITS, MEMO_IDS, MEMO_CHARS = 500_000, 5_000_000, 48
#: Units that one call of the library gets as one text.
RUN = 256

# Characters of whose kind every version of Unicode agrees; an apostrophe isn't among them, as it may begin a contraction.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ", r"!-&(-/:-@\[-`{-~"
#: The pre-tokenizer's own pieces of a text of these characters, single blanks and single line feeds.
PIECE = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|\n")
#: Units made of them, and those that are one piece.
PLAIN = rf"^(?:[{LETTERS}0-9{SIGNS}]+\n)*[{LETTERS}0-9{SIGNS}]+$"
ONE_PIECE = rf"^(?:[{LETTERS}]+|[0-9]+|[{SIGNS}]+)$"

_ENCODERS: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    """Path of the tokenizer file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    """The worker's own encoder for a file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Growing:
    """A numpy array that more can be appended to."""

    def __init__(self, first: np.ndarray):
        self.n, self.held = len(first), first

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            wider = np.empty(max(2 * self.n, self.n + len(more), 1 << 16), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class Table:
    """Codes of units of at most WIDE bytes: a hash table with open addressing whose keys are the bytes themselves.

    A key is the unit's bytes as two 64-bit numbers, and its length, plus 32
    for a unit that no blank precedes.
    """

    WIDE = 16

    def __init__(self):
        self.n = 0
        self._clear(1 << 16)

    def _clear(self, slots: int) -> None:
        self.code = np.full(slots, -1, np.int32)
        self.keys = np.zeros((slots, 2), np.uint64)
        self.kinds = np.zeros(slots, np.uint8)

    @classmethod
    def keys_of(cls, found: pa.StringArray, heads: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys, kinds, and which units are short enough."""
        _, offsets, data = found.buffers()
        offsets = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1]
        size = np.diff(offsets)
        here = np.zeros(int(offsets[-1] - offsets[0]) + 16, np.uint8)
        if len(here) > 16:
            here[:-16] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        words = np.lib.stride_tricks.as_strided(here[:8].view("<u8"), (len(here) - 7,), (1,))  # eight bytes from each place on
        at, keys = offsets[:-1] - offsets[0], np.empty((len(size), 2), np.uint64)
        full = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        keys[:, 0] = words[at] & full[np.minimum(size, 8)]
        keys[:, 1] = words[np.minimum(at + 8, len(words) - 1)] & full[np.clip(size - 8, 0, 8)]
        return keys, (np.minimum(size, cls.WIDE) + 32 * heads).astype(np.uint8), size <= cls.WIDE

    def _slots(self, keys: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (keys[:, 0] ^ (kinds.astype(np.uint64) << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29)) ^ keys[:, 1]) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(len(self.code) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Codes, -1 where unknown."""
        out, todo, slots = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slots(keys, kinds)
        while len(todo):
            code = self.code[slots]
            known = self.keys[slots]
            same = (code >= 0) & (known[:, 0] == keys[todo, 0]) & (known[:, 1] == keys[todo, 1]) & (self.kinds[slots] == kinds[todo])
            out[todo[same]] = code[same]
            on = (code >= 0) & ~same
            todo, slots = todo[on], (slots[on] + 1) & (len(self.code) - 1)
        return out

    def add(self, keys: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> None:
        """Enter distinct new keys."""
        if 2 * (self.n + len(keys)) > len(self.code):
            held = self.code >= 0
            old = self.keys[held], self.kinds[held], self.code[held]
            self._clear(1 << (2 * (self.n + len(keys))).bit_length())
            self._place(*old)
        self._place(keys, kinds, codes)
        self.n += len(keys)

    def _place(self, keys: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> None:
        codes, slots = codes.astype(np.int32), self._slots(keys, kinds)
        while len(codes):
            free = self.code[slots] < 0
            self.code[slots[free]] = codes[free]
            won = self.code[slots] == codes
            self.keys[slots[won]], self.kinds[slots[won]] = keys[won], kinds[won]
            keys, kinds, codes, slots = keys[~won], kinds[~won], codes[~won], (slots[~won] + 1) & (len(self.code) - 1)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._start(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool))
        # each character of a byte-level token stands for one byte; added tokens are plain text
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = sorted(set(added.values()))
        self.n_bytes = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)
        for i, token in added.items():
            self.n_bytes[i] = len(token.encode())

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes, straight from the library."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def learn(self, missing: list[str], n_bytes: np.ndarray) -> list[bytes]:
        """Ids of a blank and each unit, in runs that are cut again by byte counts."""
        out: list[bytes] = []
        runs = [missing[i : i + RUN] for i in range(0, len(missing), RUN)]
        joined = [" " + " ".join(r) for r in runs]
        for run, ids in zip(runs, self.library(joined), strict=True):
            places = np.cumsum(self.n_bytes[np.frombuffer(ids, "<u4")])
            ends = np.cumsum(n_bytes[len(out) : len(out) + len(run)] + 1)
            cuts = np.searchsorted(places, ends) + 1
            if cuts[-1] <= len(places) and (places[cuts - 1] == ends).all():
                to = (4 * cuts).tolist()
                out += [ids[i:j] for i, j in zip([0, *to[:-1]], to, strict=True)]
            else:  # a vocabulary whose tokens don't spell their bytes
                out += self.library([" " + u for u in run])
        return out

    def _start(self, flat: np.ndarray, size: np.ndarray, odd: np.ndarray) -> None:
        self.table, self.long = Table(), {}  # long: of units over Table.WIDE bytes; with a blank behind it, no blank precedes
        self.flat, self.size, self.begin = Growing(flat), Growing(size), Growing(np.cumsum(size) - size)
        self.odd, self.hits = Growing(odd), Growing(np.zeros(len(size), np.int32))  # odd: no cut beside it

    def _forget(self) -> None:
        """Keep only what more than one batch used, if that is little enough."""
        hits = self.hits.held[: self.hits.n]
        held = (self.table.code >= 0) & (hits[np.maximum(self.table.code, 0)] > 1) if len(hits) else self.table.code >= 0
        keys, kinds, codes = self.table.keys[held], self.table.kinds[held], self.table.code[held]
        long = [(u, c) for u, c in self.long.items() if hits[c] > 1 and len(u) <= MEMO_CHARS]
        if len(codes) + len(long) > MEMO_UNITS // 2:
            keys, kinds, codes, long = keys[:0], kinds[:0], codes[:0], []
        old = np.concatenate([codes, np.fromiter((c for _, c in long), np.int64, len(long))]).astype(np.int64)
        self._start(self._gather(old), self.size.held[old], self.odd.held[old])
        self.table.add(keys, kinds, np.arange(len(codes)))
        self.long = {u: len(codes) + i for i, (u, _) in enumerate(long)}

    def known(self) -> int:
        """How many units are remembered."""
        return self.size.n

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        """Ids of the units with these codes, in a row."""
        size = self.size.held[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat.held[np.repeat(self.begin.held[codes] - ends + size, size) + np.arange(total)]

    def _add(self, ids: np.ndarray, size: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Codes of new units, whose ids stand in a row."""
        first = self.size.n
        self.begin.add(self.flat.n + np.cumsum(size) - size)
        self.flat.add(ids)
        self.size.add(size)
        self.odd.add(odd)
        self.hits.add(np.zeros(len(size), np.int32))
        return np.arange(first, first + len(size))

    def _add_whole(self, found: pa.StringArray, odd: np.ndarray, heads: bool) -> np.ndarray:
        """Codes of new units with the ids that the library gives them."""
        names = found.to_numpy(zero_copy_only=False).tolist()
        if heads:
            ids = self.library(names)
        else:
            ids = [b""] * len(names)
            learned = np.flatnonzero(~odd)
            n_bytes = pc.binary_length(found).to_numpy().astype(np.int64)[learned]
            for i, raw in zip(learned.tolist(), self.learn([names[i] for i in learned.tolist()], n_bytes), strict=True):
                ids[i] = raw
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return self._add(np.frombuffer(b"".join(ids), "<u4"), size, odd)

    def _add_pieces(self, found: pa.StringArray) -> np.ndarray:
        """Codes of new PLAIN units after a blank, put together of their pieces."""
        pieces = pa.array(PIECE.findall(" " + " ".join(found.to_numpy(zero_copy_only=False).tolist())), pa.string()).dictionary_encode()
        blank = pc.starts_with(pieces.dictionary, " ").to_numpy(zero_copy_only=False)
        codes = np.empty(len(blank), np.int64)
        codes[blank] = self._codes(pc.utf8_slice_codeunits(pieces.dictionary.filter(pa.array(blank)), 1), False)
        codes[~blank] = self._codes(pieces.dictionary.filter(pa.array(~blank)), True)
        at = pieces.indices.to_numpy()
        first = np.flatnonzero(blank[at])
        codes = codes[at]
        return self._add(self._gather(codes), np.add.reduceat(self.size.held[codes], first), np.zeros(len(first), bool))

    def _codes(self, found: pa.StringArray, heads: bool) -> np.ndarray:
        """Codes of distinct units; unknown ones are learned."""
        if not len(found):
            return np.zeros(0, np.int64)
        keys, kinds, short = Table.keys_of(found, heads)
        out = np.full(len(found), -1, np.int64)
        out[short] = self.table.find(keys[short], kinds[short])
        wide = np.flatnonzero(~short)
        names = [u + " " if heads else u for u in found.take(pa.array(wide)).to_pylist()]
        out[wide] = np.fromiter(map(self.long.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            units_ = found.take(pa.array(new))
            # a text's first unit may begin as it likes
            inner = (pc.utf8_rtrim_whitespace if heads else pc.utf8_trim_whitespace)(units_)
            n_bytes, kept = (pc.binary_length(x).to_numpy() for x in (units_, inner))
            odd = (n_bytes == 0) | (kept != n_bytes)
            apart = np.zeros(len(new), bool)
            if not heads:
                is_ = lambda pattern: pc.match_substring_regex(units_, pattern).to_numpy(zero_copy_only=False)
                apart = is_(PLAIN) & ~is_(ONE_PIECE)
                for token in self.added:
                    apart &= ~pc.match_substring(units_, token).to_numpy(zero_copy_only=False)
            # whole ones first: pieces may be among them
            for mask, pieces in ((~apart, False), (apart, True)):
                own = new[mask]
                if len(own):
                    chosen = units_.filter(pa.array(mask))
                    out[own] = self._add_pieces(chosen) if pieces else self._add_whole(chosen, odd[mask], heads)
                    own = own[short[own]]
                    self.table.add(keys[own], kinds[own], out[own])
            self.long.update(zip(names, out[wide].tolist(), strict=True))
        self.hits.held[out] += 1
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text (None: none), without an end id."""
        ids, ends = self.encode_flat(texts)
        return np.split(ids, ends[:-1]) if len(ends) else []

    def encode_flat(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (None: none) in a row, and where each text's end."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.known() > MEMO_UNITS or self.flat.n > MEMO_IDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        n_units = pc.list_value_length(split).to_numpy().astype(np.int64)
        ends = np.cumsum(n_units)
        flat = split.flatten()
        first = ends - n_units
        heads = flat.take(pa.array(first)).dictionary_encode()
        words = flat.dictionary_encode()
        codes = self._codes(words.dictionary, False)[words.indices.to_numpy()]
        codes[first] = self._codes(heads.dictionary, True)[heads.indices.to_numpy()]
        ids, places = self._gather(codes), np.cumsum(self.size.held[codes])[ends - 1]
        odd = np.flatnonzero(np.logical_or.reduceat(self.odd.held[codes], first) & (n_units > 1))
        if len(odd):
            own = np.split(ids, places[:-1])
            for i in odd.tolist():
                own[i] = np.frombuffer(b"".join(self.library(units(texts[i].as_py()))), "<u4")
            ids, places = np.concatenate(own), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        return ids, places


def units(text: str) -> list[str]:
    """Pieces of a text that no token crosses; joined they are the text."""
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if held and p and not held[-1].isspace() and not p[0].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    out.append(held)
    return out


def with_end(ids: np.ndarray) -> np.ndarray:
    return np.append(ids, np.uint32(END_ID)).astype("<u4")
