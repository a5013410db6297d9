"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method
    A document's ids (with an end id) are one piece, or, when longer than the
    capacity, pieces of exactly the capacity with the remainder first.  What
    has to be packed is then fully described by how many pieces there are of
    each length: at most ``capacity`` numbers, whatever the size of the corpus.
    On this histogram the driver

    1. applies Martello-Toth dominance: a bin with the piece j and at most two
       others is fixed for good when no other feasible bin for j can be better,
       for all equal pieces at once, until no length can be fixed any more;
    2. packs what remains best-fit decreasing, again in bulk.

    The resulting plan says which ranks of each length go to which sequences.
    Ranks are given on the executors by a window over (length, salt), so a
    length that a third of all pieces share is spread over ``SALTS`` tasks.

Bounds
    The histogram that reaches the driver has at most capacity * SALTS rows.
    The plan that is broadcast has at most 4 * capacity groups of at most
    sqrt(2 * capacity) distinct lengths each; it doesn't grow with the corpus.

Defined cases
    Null or empty text: one piece, the end id alone.  Repeated rows: each is
    packed.  Null doc_id: packed like any other.  Empty table: no rows.
    Extra columns are ignored.  Equal lengths: by doc_id, piece and checksum.
"""

from __future__ import annotations

import bisect
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import gathered, small_batches, stage
from .tokens import END_ID, encoder

CAPACITY = 2048
SALTS = 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def piece_bounds(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document (its place), piece, start and length of all pieces: only a document's first may be short."""
    n = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = (sizes - (n - 1) * capacity)[doc]
    return doc, piece, np.where(piece == 0, 0, first + (piece - 1) * capacity), np.where(piece == 0, first, capacity)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, with_ids: with their token ids as well."""
    small_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        enc = encoder(tokenizer)
        for own in gathered(batches, 1):
            ids, ends = enc.encode_flat(own.column(1))
            ids = np.insert(ids, ends, END_ID).astype("<u4")
            size = np.diff(ends, prepend=0) + 1
            doc, piece, start, length = piece_bounds(size, capacity)
            at = (np.cumsum(size) - size)[doc] + start
            view = memoryview(ids).cast("B")
            crcs = [crc32(view[i:j]) for i, j in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
            columns = [own.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
            if with_ids:  # pieces stand in a row
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Groups:
    """Bins alike: how many, and (length, how often) of what each holds."""

    def __init__(self):
        self.fixed: list[tuple[int, list[tuple[int, int]]]] = []

    def add(self, times: int, holds: list[tuple[int, int]]) -> None:
        if times:
            self.fixed.append((times, holds))


def reduce_dominated(counts: np.ndarray, capacity: int, groups: Groups) -> None:
    """Fix dominating bins until no length can be fixed any more."""
    left = None
    while left != counts.sum():
        left = counts.sum()
        _reduce_once(counts, capacity, groups)


def _reduce_once(counts: np.ndarray, capacity: int, groups: Groups) -> None:
    """Fix bins that dominate every other bin for their largest piece, longest pieces first.

    A bin dominates another if the other's pieces fit, in parts, into the
    places of its own pieces.  counts is lowered by what was fixed.
    """
    there = [s for s in range(1, capacity + 1) if counts[s]]

    def take(s: int, k: int) -> None:
        counts[s] -= k
        if not counts[s]:
            there.remove(s)

    def smallest(n: int, without: int) -> list[int]:
        """The n smallest pieces besides one piece of the length without."""
        out: list[int] = []
        for s in there:
            out += [s] * min(n - len(out), int(counts[s]) - (s == without))
            if len(out) == n:
                break
        return out

    def fitting(room: int, without: dict[int, int]) -> int:
        """The longest piece of at most room besides those taken, 0 if none."""
        for i in range(bisect.bisect_right(there, room) - 1, -1, -1):
            if counts[there[i]] > without.get(there[i], 0):
                return there[i]
        return 0

    for j in sorted(there, reverse=True):
        while counts[j]:
            room = capacity - j
            low = smallest(3, j)
            best = fitting(room, {j: 1})
            if not best:  # nothing fits beside j
                k = int(counts[j]) if 2 * j > capacity else 1
                groups.add(k, [(j, 1)])
                take(j, k)
            elif best == room or len(low) < 2 or low[0] + low[1] > room:  # exact, or room for one only
                k = int(counts[j]) // 2 if best == j else int(min(counts[j], counts[best]))
                groups.add(k, [(j, 2)] if best == j else [(j, 1), (best, 1)])
                take(j, 2 * k if best == j else k)
                if best != j:
                    take(best, k)
            elif len(low) < 3 or sum(low) > room:  # room for two at most
                taken = {j: 1}
                taken[best] = taken.get(best, 0) + 1
                second = fitting(room - best, taken)
                above = [s for s in smallest_above(there, counts, second, j)]
                if not second or (len(above) == 2 and sum(above) <= room):
                    break  # some other pair isn't dominated
                holds: dict[int, int] = {}
                for s in (j, best, second):
                    holds[s] = holds.get(s, 0) + 1
                k = min(int(counts[s]) // n for s, n in holds.items())
                if k == 0:
                    break
                groups.add(k, list(holds.items()))
                for s, n in holds.items():
                    take(s, k * n)
            else:
                break


def smallest_above(there: list[int], counts: np.ndarray, low: int, without: int) -> list[int]:
    """The two smallest pieces longer than low, besides one of the length without."""
    out: list[int] = []
    for s in there[bisect.bisect_right(there, low) :]:
        out += [s] * min(2 - len(out), int(counts[s]) - (s == without))
        if len(out) == 2:
            break
    return out


def best_fit(counts: np.ndarray, capacity: int, groups: Groups) -> None:
    """Best-fit decreasing in bulk: equal pieces fill the fullest bins that hold them."""
    rooms: list[int] = []  # sorted free rooms with bins
    bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(room: int, times: int, holds: list[tuple[int, int]]) -> None:
        if room == 0:
            groups.add(times, holds)
        elif times:
            if room not in bins:
                bins[room] = []
                bisect.insort(rooms, room)
            bins[room].append((times, holds))

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                times, holds = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, holds = capacity, []
                times = -(-n // (capacity // s))
            each = room // s
            full = min(times, n // each)
            put(room - each * s, full, [*holds, (s, each)])
            n -= full * each
            if full < times:
                if n:
                    put(room - n * s, 1, [*holds, (s, n)])
                    n, full = 0, full + 1
                put(room, times - full, holds)
        counts[s] = 0
    for room in rooms:
        for times, holds in bins[room]:
            groups.add(times, holds)


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go.  counts[s]: pieces of length s.

    Arrays sorted by (size, first): the pieces of length size from rank first
    on go, each at a time, to the sequences from base on, at offset.
    """
    left, groups = counts.astype(np.int64).copy(), Groups()
    reduce_dominated(left, capacity, groups)
    fixed = len(groups.fixed)
    best_fit(left, capacity, groups)
    used, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for times, holds in groups.fixed:
        offset = 0
        for s, each in holds:
            rows.append((s, int(used[s]), base, each, offset))
            used[s] += times * each
            offset += s * each
        base += times
    assert (used == counts).all()
    out = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"size": out[:, 0], "first": out[:, 1], "base": out[:, 2], "each": out[:, 3], "offset": out[:, 4], "sequences": np.int64(base), "fixed_groups": np.int64(fixed)}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (PIECES) its sequence and its offset in it.

    pieces has to be a stored table: it is read twice.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    seen = salted.groupBy("length", "salt").count().toPandas()  # at most capacity * SALTS rows
    grid = np.zeros((capacity + 1, SALTS), np.int64)
    grid[seen["length"].to_numpy(int), seen["salt"].to_numpy(int)] = seen["count"].to_numpy(int)
    before = np.cumsum(grid, axis=1) - grid
    made = plan(grid.sum(axis=1), capacity)
    shared = spark.sparkContext.broadcast((before, {k: v for k, v in made.items() if v.ndim}))

    def run(batches):
        before, p = shared.value
        span = np.int64(1) << 44
        keys = p["size"] * span + p["first"]
        for batch in batches:
            size, salt, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            rank = rank - 1 + before[size, salt]
            at = np.searchsorted(keys, size * span + rank, side="right") - 1
            nth = rank - p["first"][at]
            sequence, offset = p["base"][at] + nth // p["each"][at], p["offset"][at] + nth % p["each"][at] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    return salted.withColumn("rank", rank).select("doc_id", "piece", "start", "length", "ids_crc32", "salt", F.col("rank").cast("long").alias("rank")).mapInArrow(run, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places (PLACED)."""
    return place(stage(cut_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids and their starts.

    A sequence holds at most capacity ids, so its group is bounded.  Copies of
    one row are told apart by their rank.
    """
    same = Window.partitionBy("doc_id", "piece", "ids_crc32")
    told = lambda df, *order: df.withColumn("copy", F.row_number().over(same.orderBy(*order)))
    ids = told(cut_pieces(docs, tokenizer, capacity, with_ids=True), "start").select("doc_id", "piece", "ids_crc32", "copy", "ids")
    both = told(placed, "sequence_id", "offset").withColumnsRenamed({"doc_id": "d", "piece": "p", "ids_crc32": "c", "copy": "n"})
    joined = both.join(ids, (F.col("d").eqNullSafe(F.col("doc_id"))) & (F.col("p") == F.col("piece")) & (F.col("c") == F.col("ids_crc32")) & (F.col("n") == F.col("copy")))
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    return joined.groupBy("sequence_id").agg(held.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
