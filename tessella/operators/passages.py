"""Passages that texts share: windows of characters, compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WIDTH = 60
#: Bits of the map of known windows that travels to the tasks: 64 MB, however many windows there are.
MAP_BITS = 29


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all windows of width code points, from prefix sums: a polynomial over mixed code points."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        down, up = powers(INVERSE, len(x)), powers(BASE, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * down, dtype=np.uint64)])
        out = (sums[width:] - sums[:-width]) * up
        return out ^ (out >> np.uint64(29))


def all_hashes(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """h: the distinct window hashes of df's texts."""

    def run(batches):
        for batch in batches:
            own = [window_hashes(t, width) for t in batch.column(0).to_pylist() if t]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own or [np.zeros(0, np.uint64)])).view(np.int64))], names=["h"])

    return df.select("text").mapInArrow(run, "h long").distinct()


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of 2^bits bits with the lowest bits of each hash (h) set; it is made in pieces of 4 kB, so its size alone comes to the driver."""
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    pieces = hashes.select(F.shiftright(place, 15).alias("piece"), F.pmod(place, F.lit(1 << 15)).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(1 << max(bits - 3, 12), np.uint8)
    for r in pieces.toLocalIterator():
        out[4096 * r["piece"] : 4096 * (r["piece"] + 1)] = np.frombuffer(r["map"], np.uint8)
    return out


def in_map(held: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    place = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def windows(df: DataFrame, *keep: str, width: int = WIDTH, held=None, bits: int = MAP_BITS) -> DataFrame:
    """keep, i, h, w of each window of df's texts, or of those that the broadcast map held knows."""
    fields = [f for f in df.select(*keep).schema.fields]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "i int, h long, w string"])

    def run(batches):
        known = None if held is None else held.value
        for batch in batches:
            rows, places, hashes, found = [], [], [], []
            for r, text in enumerate(batch.column(len(keep)).to_pylist()):
                if not text or len(text) < width:
                    continue
                h = window_hashes(text, width)
                at = np.arange(len(h)) if known is None else np.flatnonzero(in_map(known, h, bits))
                rows += [r] * len(at)
                places += at.tolist()
                hashes += h[at].view(np.int64).tolist()
                found += [text[i : i + width] for i in at.tolist()]
            index = pa.array(rows, pa.int64())
            made = [pa.array(places, pa.int32()), pa.array(hashes, pa.int64()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(index) for c in range(len(keep))], *made], names=[*keep, "i", "h", "w"])

    return df.select(*keep, "text").mapInArrow(run, schema)


def overlaps(docs: DataFrame, passages: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, first_offset, windows of documents that hold a window of a passage.

    One plan at every size: a bit map of the passages' windows, whose size
    depends on nothing, spares windows that can't match; the others are joined
    by hash and compared as strings.  Where passages have very many windows
    the map spares less, and the join does more.
    """
    hashes = all_hashes(passages, width)
    held = docs.sparkSession.sparkContext.broadcast(bit_map(hashes, MAP_BITS))
    known = windows(passages.where(F.length("text") >= width).withColumn("one", F.lit(1)), "one", width=width).select("h", "w").distinct()
    found = windows(docs, "doc_id", width=width, held=held, bits=MAP_BITS).join(known, ["h", "w"], "left_semi")
    return found.groupBy("doc_id").agg(F.min("i").cast("long").alias("first_offset"), F.count(F.lit(1)).alias("windows"))
