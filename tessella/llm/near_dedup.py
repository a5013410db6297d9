"""MinHash near-dedup: SuperMinHash, banding, verification, union-find.

Signatures
    A text's set is its distinct shingles of ``n`` words (ASCII letters
    lower-cased, words ``[^\\x20\\x09-\\x0D]+``), each as a 64-bit number; a text
    with fewer words has its whole sequence as its only shingle.  SuperMinHash
    gives each shingle a random permutation of the signature's places, drawn
    step by step, and at step j a rank in [j, j + 1).  A place keeps its
    smallest rank, so a document is done at the first step that can't lower any
    place; for most that is after a few steps.

Candidates
    Documents with equal sets are one class, stood for by the smallest id.
    ``BANDS`` bands of ``ROWS`` places each are hashed; classes that share a
    band's hash share a bucket.

Links
    1. Each class is compared with one centre: of all classes that share a
       bucket with it the one that shares buckets most often.  That is one pair
       per class, however large a bucket is, and connects nearly all that
       belongs together, as the text that others derive from is the centre.
    2. Buckets whose classes aren't all in one component afterwards are open.
       Classes that open buckets connect form a group, and all pairs of a group
       whose components differ are counted exactly, as products of bit
       matrices, in blocks: a group is dealt by hash into blocks of bounded
       numbers of classes and shingles, and a task gets two blocks.  What it
       emits is a spanning forest of the links it found, never the pairs, so
       rows grow with the classes even where all are a little below the
       similarity; a group of one block, which nearly all are, costs one task.
    Every two classes that share a bucket have then been compared or are
    connected, so no link between candidates is lost.  Comparing reads the
    whole texts and counts on full sets.  Only a pair that shares no bucket can
    be missed: at similarity 0.8 that is (1 - 0.8^ROWS)^BANDS = 2e-6, and less
    above.

Components
    Edges are first contracted by union-find in each task, then by alternating
    large-star and small-star steps, each written to the shared folder, until
    nothing changes.  Edges and components never reach the driver.

Defined cases
    Null or empty text, or one without words: empty set, no link, kept.
    Repeated rows: equal sets, so one class.  Different texts under one doc_id:
    links of any of them are links of the doc_id, and all its rows have the
    same component.  Null doc_id: own set size, linked with nothing, kept.
    Empty table: no rows.  Extra columns are ignored by ``components`` and kept
    by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, parts, small_batches, stage, utf8

PLACES, BANDS, ROWS = 252, 42, 6
MAX_ROUNDS = 60
#: Classes and shingles of a block that a task compares with another.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_000_000
#: The largest bitmap of ids that is broadcast has 2^MAP_BITS bits, 64 MB.
MAP_BITS = 29
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_WORDS: dict[bytes, int] = {}


def word_numbers(words: list[bytes]) -> list[int]:
    """64-bit hashes of words, remembered in the worker."""
    if len(_WORDS) > 150_000:
        _WORDS.clear()
    digest = hashlib.blake2b
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = int.from_bytes(digest(w, digest_size=8).digest(), "little")
    return list(map(_WORDS.__getitem__, words))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingles of a whole text as 64-bit numbers."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, U)
    k = min(n, len(words))
    x = np.array(word_numbers(words), U)
    with np.errstate(over="ignore"):
        h = x[: len(x) - k + 1].copy()
        for i in range(1, k):
            h = mix(h * U(0x9E3779B97F4A7C15) + x[i : len(x) - k + 1 + i])
    return np.unique(h)


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures of non-empty sets: a row of places 64-bit ranks each."""
    m, n_docs = places, len(sets)
    h = np.full(n_docs * m, np.iinfo(np.uint64).max, U)
    if not n_docs:
        return h.reshape(0, m)
    doc = np.repeat(np.arange(n_docs), [len(s) for s in sets])
    seed = np.concatenate(sets)
    perm = np.tile(np.arange(m, dtype=np.uint16 if m > 255 else np.uint8), (len(seed), 1))
    rows = np.arange(len(seed))
    with np.errstate(over="ignore"):
        for j in range(m):
            r = mix(seed + U(j + 1) * U(0x9E3779B97F4A7C15))
            k = j + ((r >> U(32)) % U(m - j)).astype(np.int64)
            picked = perm[rows, k]
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = picked
            np.minimum.at(h, doc * m + picked, (U(j) << U(32)) | (r & U(0xFFFFFFFF)))
            if j + 1 == m:
                break
            open_ = (h.reshape(n_docs, m).max(axis=1) >> U(32)) > U(j)  # a place could still get lower
            if not open_.all():
                keep = open_[doc]
                doc, seed, perm = doc[keep], seed[keep], perm[keep]
                rows = np.arange(len(seed))
            if not len(seed):
                break
    return h.reshape(n_docs, m)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash per band; equal bands of equal places get equal hashes."""
    with np.errstate(over="ignore"):
        out = np.tile(mix(np.arange(1, bands + 1, dtype=U) * U(0xD6E8FEB86659FD93)), (len(signatures), 1))
        for i in range(rows):
            out = mix(out * U(0x9E3779B97F4A7C15) + signatures[:, i : bands * rows : rows])
    return out


SKETCH = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def sketches(docs: DataFrame, n: int, places: int = PLACES, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the set, null: empty), bands."""

    def run(batches):
        for batch in batches:
            for own in parts(batch, 1, limit=600_000):
                sets = [shingles(t, n) for t in own.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                hashes = iter(band_hashes(super_minhash(full, places), bands, rows).view(np.int64))
                found = [next(hashes) if len(s) else None for s in sets]
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "bands"])

    return docs.mapInArrow(run, SKETCH)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct rows of docs (doc_id, text) with a doc_id in ids.

    A bitmap of the ids' hashes, at most 2^MAP_BITS bits in pieces of 4 kB, is
    broadcast first, so that texts that aren't asked for aren't shuffled.
    """
    bits = 1 << min(MAP_BITS, max(20, (64 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    at, within = F.shiftright(place, 15), F.pmod(place, F.lit(1 << 15))
    maps = ids.select(at.alias("piece"), within.alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.substring(F.col("map"), (F.floor(within / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    asked = docs.withColumn("piece", at).join(F.broadcast(maps), "piece").where(F.getbit(byte, F.pmod(within, F.lit(8)).cast("int")) == 1)
    return asked.select("doc_id", "text").join(ids, "doc_id", "left_semi").dropDuplicates()


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b of the pairs whose full sets have 100 * common >= percent * union."""
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b")

    def run(batches):
        for batch in batches:
            for own in parts(batch, 2, 3):
                known: dict[str, np.ndarray] = {}
                keep = []
                for tx, ty in zip(own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True):
                    for t in (tx, ty):
                        if t not in known:
                            known[t] = shingles(t, n)
                    p, q = known[tx], known[ty]
                    common = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                    keep.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets have in common."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    core = times == n  # in all sets
    total = np.full((n, n), float(core.sum()), np.float32)
    shared = (times > 1) & ~core
    rank = np.cumsum(shared) - 1
    inside = shared[place]
    doc, at = doc[inside], rank[place[inside]]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    for low in range(0, int(shared.sum()), columns):
        i, j = np.searchsorted(at, (low, low + columns))
        bits = np.zeros((n, columns), np.float32)
        bits[doc[i:j], at[i:j] - low] = 1.0
        total += bits @ bits.T
    return total.astype(np.int64)


def forest(ids: np.ndarray, components: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different components; side: 0 and 1 for two blocks, all 0 for one."""
    size = np.array([len(s) for s in sets])
    common = common_counts(sets)
    near = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (components[:, None] != components[None, :])
    near &= (side[:, None] < side[None, :]) if side.any() else np.triu(np.ones(near.shape, bool), 1)
    parent = {int(c): int(c) for c in components}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in np.argwhere(near).tolist():
        p, q = find(int(components[i])), find(int(components[j]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ids[i]), int(ids[j])))
    return out


def group_links(rest: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links that connect all of rest (doc_id, component, group) that links inside its groups connect.

    rest is a stored table with one row per doc_id.
    """

    def sets_of(batches):
        for batch in batches:
            for own in parts(batch, 3):
                sets = [shingles(t, n).view(np.int64) for t in own.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "component", "group", "size", "h"])

    held = stage(texts.join(rest, "doc_id").select("doc_id", "component", "group", "text").mapInArrow(sets_of, "doc_id long, component long, group long, size long, h array<long>"), "sets")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    dealt = held.join(stage(held.groupBy("group").agg(blocks.alias("blocks")), "groups"), "group").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = dealt.select("group", "doc_id", "component", "h", "block", every).select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component", "h")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, block = table["i"].to_numpy(), table["block"].to_numpy()
        links = forest(table["doc_id"].to_numpy(), table["component"].to_numpy(), [np.asarray(x.values) for x in table["h"]], (block != i).astype(int), percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return sent.groupBy("group", "i", "j").applyInArrow(run, "a long, b long")


def contracted(edges: DataFrame) -> DataFrame:
    """Per task, each node's edge to the smallest node that the task's edges connect it with."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def edges_out():
            nodes = list(parent)
            roots = [find(x) for x in nodes]
            parent.clear()
            pairs = [(x, r) for x, r in zip(nodes, roots, strict=True) if x != r]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                p, q = find(x), find(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if len(parent) > 500_000:  # bounded memory: pass on what is known and start anew
                yield edges_out()
        yield edges_out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node that has an edge.

    Edges are kept as (a, b) with a > b.  Large-star links each node's larger
    neighbours to its smallest; small-star links its smaller ones.  A round
    that changes no edge ends it.
    """
    ordered = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(ordered(contracted(edges)), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(now.select(F.col("b").alias("x"), F.col("a").alias("y")))
        # stored, so that the join is split where one node has very many neighbours
        low = stage(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "lowest")
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("a"), F.col("m").alias("b"))
        large = ordered(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stage(ordered(small), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")


def components(docs: DataFrame, n: int = 5, percent: int = 80, places: int = PLACES, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = stage(sketches(own, n, places, bands, rows), "sketches")
    # stored, as a join with an aggregate of the same rows isn't split where it is skewed
    classes = stage(made.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    rep = F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")
    member = stage(made.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left").select("doc_id", "n_shingles", "set_id", rep), "members")
    reps = made.join(classes, (made["set_id"] == classes["set_id"]) & (made["doc_id"] == classes["rep"])).groupBy("doc_id", made["set_id"]).agg(F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    # ids with several texts connect their classes
    several = member.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).where("b <> high").drop("high")
    own_links = member.join(several, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    keys = reps.select("doc_id", "size", F.posexplode("bands").alias("band", "key"))
    # a bucket with one class has no pair; the band is part of the key's hash
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stage(keys.join(crowded, "key").select("key", "n", "doc_id", "size"), "buckets")
    texts = stage(texts_of(own, buckets.select("doc_id").distinct()), "texts")
    shared = buckets.groupBy("doc_id").agg(F.sum("n").alias("shared"))
    rated = buckets.join(shared, "doc_id").select("key", "doc_id", F.struct("shared", (-F.col("doc_id")).alias("id")).alias("rate"))
    best = rated.join(rated.groupBy("key").agg(F.max("rate").alias("best")), "key").groupBy("doc_id").agg(F.max("best").alias("best"))
    first = stage(best.select(F.col("doc_id").alias("a"), (-F.col("best.id")).alias("b")).where("a <> b"), "pairs")
    links = stage(verified(first, texts, n, percent).unionByName(own_links), "links")
    label = connect(links)
    # what shares a bucket without being connected yet
    labelled = stage(buckets.join(label, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "labelled")
    split = labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("doc_id").alias("low")).where("c0 <> c1").select("key", "low")
    rest = stage(labelled.join(split, "key"), "open")
    together = connect(rest.where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    rest = stage(rest.select("doc_id", "component").distinct().join(together.withColumnRenamed("component", "group"), F.col("doc_id") == F.col("node")).drop("node"), "groups")
    label = connect(links.unionByName(stage(group_links(rest, texts, n, percent), "links")))
    out = member.join(label, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, with all their columns; of rows alike in doc_id all or none."""
    kept_id = free_name(docs, "__kept_id")
    kept = components(docs, n, percent).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
