"""Periodic runs of words by Main and Lorentz's divide and conquer.

A run is a stretch of words with smallest period q, at least ``least`` words
and ``times`` * q long, that no neighbouring word extends keeping the period.

Method
    Words of a batch of texts are interned as numbers.  A segment is halved;
    Z-functions at the midpoint (of the right half, and of the reversed left
    half against the reversed segment; then the same of the mirrored segment)
    tell for every period how far a repetition that crosses the midpoint goes
    each way.  What ends at the segment's border and goes on beyond it crosses
    a midpoint further up, where it was found whole.  Intervals found for
    several periods keep the smallest.  Both halves follow.

    A word of a run stands in it ``times`` times or more.  So before a segment
    is halved, words that it holds less often are cut out, by a sort of all
    segments of one depth of all texts of a batch; texts without repetitions
    are done after one sort.

Collapsing
    A word is dropped if a run holds it after the run's first q words.

Bounds
    O(n log n) for a text of n words; memory follows a batch's texts, of about
    2.5 MB or one text.  There is no shuffle.

Defined cases
    Null or empty text, or one without words: no run, collapsed to an empty
    text.  Repeated rows and null doc_id: a row each.  Very long texts: whole.
    Equal intervals: one run with the smallest period.  Empty table: no rows.
    Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import WORD, gathered, small_batches

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def z_function(x: list[int]) -> list[int]:
    """z[i]: how many elements x and x[i:] begin with in common; z[0] is the length."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    low = high = 0
    for i in range(1, n):
        k = 0
        if i < high:
            k = z[i - low]
            if k < high - i:
                z[i] = k
                continue
            k = high - i
        while i + k < n and x[i + k] == x[k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def crossing(x: list[int], middle: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the repetitions of x that hold middle - 1, middle and middle + period."""
    right = x[middle:]
    n = len(right)
    # of times >= 4 periods two lie on one side of the midpoint; the mirrored call finds those on the left
    own = 1 if times >= 4 else 0
    if own and right[0] not in right[1 : n // 2 + 1]:
        return []
    ahead = [*z_function(right), 0]
    periods = [p for p in range(1, n // 2 + 1 if own else n + 1) if ahead[p] >= own * p]
    if not periods:
        return []
    back = z_function([*x[:middle][::-1], -1, *x[::-1]])[middle + 1 :]
    out = []
    for p in periods:
        start, end = middle - back[n - p], middle + p + ahead[p]
        if end - start >= max(least, times * p):
            out.append((start, end, p))
    return out


def frequent(words: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments [low, high) cut at words that a segment holds fewer than times times; pieces shorter than least are left out."""
    while len(low):
        size = high - low
        ends = np.cumsum(size)
        segment = np.repeat(np.arange(len(low)), size)
        at = np.repeat(low - ends + size, size) + np.arange(int(ends[-1]))
        _, place, counts = np.unique(segment * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        kept = counts[place] >= times
        edge = np.ones(len(at), bool)
        edge[1:] = (segment[1:] != segment[:-1]) | ~kept[:-1]
        first = np.flatnonzero(kept & edge)
        edge[:-1] = (segment[1:] != segment[:-1]) | ~kept[1:]
        edge[-1] = True
        last = np.flatnonzero(kept & edge)
        long = last - first + 1 >= least
        before, low, high = int(size.sum()), at[first[long]], at[last[long]] + 1
        if int((high - low).sum()) == before:
            break
    return low, high


def find_runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of the runs of texts that stand at [begin, end) of words, by start and period."""
    found: dict[tuple[int, int], int] = {}
    low, high = begins, ends
    while True:
        low, high = frequent(words, low, high, least, times)
        if not len(low):
            break
        text = np.searchsorted(begins, low, side="right") - 1
        halves = []
        for i, j, first, last in zip(low.tolist(), high.tolist(), begins[text].tolist(), ends[text].tolist(), strict=True):
            x = words[i:j].tolist()
            n, m = j - i, (j - i) // 2
            mirrored = [(n - e, n - s, p) for s, e, p in crossing(x[::-1], n - m, least, times)]
            for s, e, p in crossing(x, m, least, times) + mirrored:
                s, e = i + s, i + e
                if (s == first or words[s - 1] != words[s - 1 + p]) and (e == last or words[e] != words[e - p]):
                    found[s, e] = min(p, found.get((s, e), p))
            halves += [(i, i + m), (i + m, j)]
        low, high = (np.array(x, np.int64) for x in zip(*halves, strict=True))
        long = high - low >= least
        low, high = low[long], high[long]
    runs = sorted((s, p, e) for (s, e), p in found.items())
    start, period, end = (np.array([r[k] for r in runs], np.int64) for k in range(3))
    return start, end, period


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, period; by start, then period), collapsed (kept words, joined by one space)."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in gathered(batches, 1):
            split = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
            text = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
            flat = split.flatten()
            full = pc.greater(pc.binary_length(flat), 0)
            flat, text = flat.filter(full), text[full.to_numpy(zero_copy_only=False)]
            n_words = np.bincount(text, minlength=len(split))
            ends = np.cumsum(n_words)
            begins = ends - n_words
            some = n_words >= least
            words = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            start, end, period = find_runs(words, begins[some], ends[some], least, times)
            # +1 where a run's repetition begins, -1 where it ends
            deep = np.zeros(len(words) + 1, np.int64)
            np.add.at(deep, start + period, 1)
            np.add.at(deep, end, -1)
            kept = np.cumsum(deep[:-1]) == 0
            left = np.append(0, np.cumsum(np.bincount(text[kept], minlength=len(split))))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept))), " ")
            owner = np.searchsorted(ends, start, side="right")
            n_runs = np.append(0, np.cumsum(np.bincount(owner, minlength=len(split))))
            structs = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(n_runs, pa.int32()), structs), collapsed], names=["doc_id", "n_words", "runs", "collapsed"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs; in a tenth of the texts (crc32 of doc_id) the words from some place on repeat: word i >= a becomes word a + (i - a) % p.

    With h the crc32 of decimal doc_id and g = floor(h / 10), a text of n words
    is one of them if h % 10 = 0 and n > 0; a = g % n, p = 1 + floor((n - a) /
    (3 + g % 8)).  Their words are then joined by one space.  Others, and rows
    with null doc_id, stay as they are.
    """
    words = F.col("words")
    n, g = F.size("words").cast("long"), F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)
    made = docs.select("doc_id", "text").withColumn("words", F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    placed = made.withColumn("a", F.when(n > 0, F.pmod(g, n))).withColumn("p", F.floor((n - F.col("a")) / (F.pmod(g, F.lit(8)) + 3)) + 1)
    tail = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(words, (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
