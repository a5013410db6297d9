"""Chunks of texts: sentences packed greedily, with an overlap between neighbours.

A chunk never crosses a document.  The fold over a document's sentences is
sequential, so it runs in Arrow batches, one document at a time; memory follows
the longest document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import SENTENCE

TARGET, OVERLAP, HARD = 600, 60, 540
HAN = re.compile(r"[⺀-⿟々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003FFFF]")
SCHEMA = "doc_id long, chunk_index int, content string, token_count int, content_hash string"


def normalised(text: str) -> str:
    """normalize_minimal for one text."""
    return re.sub(r"[^\S\n]+(?=\n|\Z)", "", re.sub(r"\r\n?", "\n", text))


def estimate(text: str) -> int:
    han = len(HAN.findall(text))
    return math.floor(0.81 * han + 0.3 * (len(text) - han) + 0.5)


def pieces_within(text: str, limit: int, count: Callable[[str], int]) -> list[str]:
    """text in consecutive pieces of at most limit tokens, each as long as possible."""
    out = []
    while text:
        low, high = 1, len(text)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(text[:mid]) <= limit else (low, mid - 1)
        out.append(text[:low])
        text = text[low:]
    return out


def tail(text: str, limit: int, count: Callable[[str], int]) -> str:
    """The longest end of text with at most limit tokens."""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(text[len(text) - mid :]) <= limit else (low, mid - 1)
    return text[len(text) - low :] if low else ""


def overlap_of(chunk: str, limit: int, count: Callable[[str], int]) -> str:
    """What the next chunk repeats: the whole chunk if it is short, else as many last sentences as fit, else the longest end."""
    if count(chunk) <= limit:
        return chunk
    held, total = "", 0
    for unit in reversed(re.findall(SENTENCE, chunk)):
        total += count(unit)
        if total > limit:
            break
        held = unit + held
    return held or tail(chunk, limit, count)


def chunk_text(text: str, count: Callable[[str], int] = estimate, target: int = TARGET, overlap: int = OVERLAP, hard: int = HARD) -> list[str]:
    """Sentences packed greedily up to target tokens, each sentence counted by itself.

    A chunk begins with the overlap of the one before it if its first sentence
    still fits beside it.  A sentence beyond target is cut into pieces of at
    most hard tokens, each a chunk of its own after the overlap.
    """
    out: list[str] = []
    held, size, room = "", 0, target  # size: tokens of the sentences, without the overlap

    def close():
        nonlocal held, size, room
        if held:
            out.append(held)
        held, size, room = "", 0, target

    for unit in re.findall(SENTENCE, text):
        n = count(unit)
        if n > target:
            close()
            for piece in pieces_within(unit, hard, count):
                out.append((overlap_of(out[-1], overlap, count) if out else "") + piece)
        elif held and size + n <= room:
            held, size = held + unit, size + n
        else:
            close()
            before = overlap_of(out[-1], overlap, count) if out else ""
            spent = count(before)
            if before and n <= target - spent:
                held, room = before + unit, target - spent
            else:
                held = unit
            size = n
    close()
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: Callable[[str], int] = estimate) -> DataFrame:
    """SCHEMA of every document; null or empty texts have no chunks.  count tells how many tokens a text has, such as a ``segment.VocabularyCounter``."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, c in enumerate(chunk_text(text or "", count)):
                    for column, value in zip(rows, (doc_id, i, c, count(c), hashlib.sha256(normalised(c).encode("utf-8", "surrogatepass")).hexdigest()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "chunk_index", "content", "token_count", "content_hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def with_keys(made: DataFrame, book: int = 1) -> DataFrame:
    """chunk_key and the keys of the neighbours inside the document."""
    key = F.format_string("book:%d:chapter:%d#c%d", F.lit(book), F.col("doc_id"), F.col("chunk_index"))
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    keyed = made.withColumn("chunk_key", key)
    return keyed.withColumn("prev_chunk_key", F.lag("chunk_key").over(order)).withColumn("next_chunk_key", F.lead("chunk_key").over(order))
