"""Content-addressed store of token ids.

Format (Parquet, below one folder)
    ``data/kind=chunk``   digest, n, payload: each distinct chunk once, payload
                          the little-endian ids, two bytes each where all fit
                          (width 2), else four.
    ``recipes``           in ascending doc_id order: doc_id, n_tokens, root,
                          chunks (digest and length in order), part, seq.
    ``manifest``          per recipe part: rows, ids, smallest and largest
                          doc_id, and the Merkle root over its recipes' roots.

Chunks
    A gear hash over 32 ids cuts each document's stream where its low bits are
    zero, between MIN_IDS and MAX_IDS ids, so documents that share passages
    share chunks.  A digest is 128 bits of BLAKE2b over the ids as unsigned
    32-bit integers.  A document's root is the Merkle root of its chunk digests.

Writing
    One pass over the texts emits recipes and chunks (each chunk once per
    task, so a hot chunk meets at most as many copies as there are tasks) into
    one shuffle, chunks by digest, in which each distinct one is kept once, and
    recipes anywhere, so copies of one document are spread.

Reading
    Every chunk file is read, each payload's digest is recomputed and has to be
    the one it is stored under, and the recipe's root has to follow from its
    digests.  A document's checksum follows from its chunks' checksums (CRC-32
    of a concatenation is a function of both parts), so no payload has to move.
    ``documents_of`` rebuilds the ids themselves.

Defined cases
    Null or empty text: the end id alone.  Repeated rows: one recipe each,
    ordered by root.  Null doc_id: first.  Empty table: empty files, no rows.
    Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import gathered, small_batches, stage_path
from .tokens import END_ID, encoder

MIN_IDS, MASK_BITS, MAX_IDS = 128, 8, 1024
CHUNKS = "array<struct<digest: binary, n: int>>"
ROWS = f"kind string, key long, doc_id long, n_tokens long, root binary, chunks {CHUNKS}, digest binary, n int, width int, payload binary"
CHUNK_TYPE = pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())]))


def gear_table() -> np.ndarray:
    """65,536 32-bit numbers, splitmix64 of 1 to 65,536."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 65_537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def rolling(ids: np.ndarray) -> np.ndarray:
    """Gear hash at each place: the sum of GEAR over the last 32 ids, shifted by their distance."""
    h = GEAR[ids & np.uint32(0xFFFF)].copy()
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream."""
    return cut_all(ids, np.array([len(ids)]))[0].tolist() if len(ids) else []


def cut_all(ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of streams that stand in a row, and how many each has.

    The first MIN_IDS places of a stream are never an end, so what stands
    before it in the row doesn't matter.
    """
    marks = np.flatnonzero((rolling(ids) >> np.uint32(32 - MASK_BITS)) == 0) + 1
    first = np.searchsorted(marks, np.append(0, doc_ends)).tolist()
    marks, at, ends, counts = marks.tolist(), 0, [], []
    for i, to in enumerate(doc_ends.tolist()):
        n = len(ends)
        if to - at > MIN_IDS:
            for m in marks[first[i] : first[i + 1]]:
                while m - at > MAX_IDS:
                    at += MAX_IDS
                    ends.append(at)
                if m - at >= MIN_IDS:
                    at = m
                    ends.append(at)
        while to - at > MAX_IDS:
            at += MAX_IDS
            ends.append(at)
        if at < to:
            ends.append(to)
            at = to
        counts.append(len(ends) - n)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def digest_of(ids: np.ndarray) -> bytes:
    return blake2b(ids.astype("<u4"), digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; an odd one out moves up unchanged."""
    level = [blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        level = [blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else blake2b(b"", digest_size=16).digest()


def _zero_byte() -> list[int]:
    """What a zero byte makes of each bit of a CRC-32 register: 32 columns over GF(2)."""
    out = []
    for bit in range(32):
        x = 1 << bit
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _tables(columns: list[int]) -> np.ndarray:
    """The linear map with these columns as four tables of 256, one per byte of the register."""
    out = np.zeros((4, 256), np.uint32)
    for i in range(4):
        for bit in range(8):
            out[i, 1 << bit : 2 << bit] = out[i, : 1 << bit] ^ np.uint32(columns[8 * i + bit])
    return out


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


#: Maps for 1, 2, 4, ... zero bytes, made as they are needed.
_ZEROS: list[np.ndarray] = []


def crc_join(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations of parts: of the parts from each first on up to the next.

    The register is linear over GF(2), so each part's CRC is carried over the
    bytes behind it, by the binary digits of their number, and all are summed.
    """
    ends = np.cumsum(sizes)
    last = np.append(first[1:], len(sizes)) - 1
    after = np.repeat(ends[last], np.diff(np.append(first, len(sizes)))) - ends
    out = crcs.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        if k == len(_ZEROS):
            unit = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
            _ZEROS.append(_tables(_mapped(_ZEROS[-1], _mapped(_ZEROS[-1], unit)).tolist() if _ZEROS else _zero_byte()))
        at = np.flatnonzero((after >> k) & 1)
        out[at] = _mapped(_ZEROS[k], out[at])
    return np.bitwise_xor.reduceat(out, first) if len(first) else np.zeros(0, np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish, as signed numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """data cut at ends (the first one 0), without a Python object per part."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


ROW_TYPES = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "root": pa.binary(), "chunks": CHUNK_TYPE, "digest": pa.binary(), "n": pa.int32(), "width": pa.int32(), "payload": pa.binary()}


def padded(kind: str, key: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of ROWS with nulls for all other columns."""
    rest = [columns[c].cast(t) if c in columns else pa.nulls(len(key), t) for c, t in ROW_TYPES.items()]
    return pa.RecordBatch.from_arrays([pa.array([kind]).take(pa.array(np.zeros(len(key), np.int64))), pa.array(key), *rest], names=["kind", "key", *ROW_TYPES])


def write_store(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents' ids to a store below path."""
    spark = docs.sparkSession
    small_batches(spark)

    def emit(batches):
        enc, sent, n_rows = encoder(tokenizer), set(), 0
        for own in gathered(batches, 1):
            ids, doc_ends = enc.encode_flat(own.column(1))
            ids = np.insert(ids, doc_ends, END_ID).astype("<u4")
            doc_ends = doc_ends + np.arange(1, own.num_rows + 1)
            ends, counts = cut_all(ids, doc_ends)
            starts = np.concatenate([[0], ends[:-1]])
            whole = memoryview(ids).cast("B")
            digests = [blake2b(whole[4 * i : 4 * j], digest_size=16).digest() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            last = np.cumsum(counts).tolist()
            roots = [merkle(digests[i:j]) for i, j in zip([0, *last[:-1]], last, strict=True)]
            digest, n = binaries(b"".join(digests), 16 * np.arange(len(ends) + 1)), pa.array((ends - starts).astype(np.int32))
            pieces = pa.ListArray.from_arrays(pa.array(np.array([0, *last], np.int32)), pa.StructArray.from_arrays([digest, n], names=["digest", "n"]))
            sizes = pa.array(np.diff(doc_ends, prepend=0))
            # recipes go anywhere, but to the same place whenever the task is run again
            key = mixed(np.arange(n_rows, n_rows + own.num_rows, dtype=np.uint64) ^ np.frombuffer(b"".join(r[:8] for r in roots), np.uint64))
            n_rows += own.num_rows
            yield padded("recipe", key, {"doc_id": own.column(0), "n_tokens": sizes, "root": pa.array(roots, pa.binary()), "chunks": pieces})
            fresh = np.zeros(len(ends), bool)
            for i, d in enumerate(digests):
                if d not in sent:
                    sent.add(d)
                    fresh[i] = True
            wide = np.maximum.reduceat(ids, starts) > 0xFFFF
            key = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            for width, mask in ((2, fresh & ~wide), (4, fresh & wide)):
                if mask.any():
                    payload = binaries(ids.astype(f"<u{width}").tobytes(), width * np.append(starts, ends[-1]))
                    mine = pa.array(mask)
                    yield padded("chunk", key[mask], {"digest": digest.filter(mine), "n": n.filter(mine), "width": pa.array(np.full(int(mask.sum()), width, np.int32)), "payload": payload.filter(mine)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(emit, ROWS)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # of equal chunks of several tasks the first stays
    same = Window.partitionBy("kind", "key").orderBy("digest")
    kept = rows.withColumn("before", F.lag("digest").over(same)).where("kind = 'recipe' or before is null or before <> digest")
    kept.drop("key", "before").write.partitionBy("kind").parquet(f"{path}/data", compression="zstd")

    recipes = _read(spark, f"{path}/data", "kind string, doc_id long, n_tokens long, root binary, chunks " + CHUNKS).where("kind = 'recipe'").drop("kind")
    ordered = recipes.repartitionByRange(n_parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered = ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    ordered.write.parquet(f"{path}/recipes", compression="zstd")
    written = _read(spark, f"{path}/recipes", RECIPE)
    manifest_rows(written).write.parquet(f"{path}/manifest")


RECIPE = f"doc_id long, n_tokens long, root binary, chunks {CHUNKS}, part int, seq long"
MANIFEST = "part int, block long, rows long, ids long, low long, high long, root binary"
MANIFEST_NAMES = ["part", "block", "rows", "ids", "low", "high", "root"]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def manifest_rows(recipes: DataFrame) -> DataFrame:
    """The manifest (MANIFEST) of recipes: rows, ids, ends and Merkle root of each block."""
    leaves = F.array_sort(F.collect_list(F.struct("seq", "root")))
    sums = recipes.withColumn("block", F.floor(F.col("seq") / 1024)).groupBy("part", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), leaves.alias("leaves"))

    def roots(batches):
        for batch in batches:
            root = [merkle([x["root"] for x in xs]) for xs in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(root, pa.binary())], names=MANIFEST_NAMES)

    return sums.select("part", "block", "rows", "ids", "low", "high", "leaves").mapInArrow(roots, MANIFEST)


def checked_blocks(spark: SparkSession, path: str, recipes: DataFrame) -> DataFrame:
    """part, block, ids of the manifest; a block that isn't what its recipes give ends the job."""
    names = ["rows", "ids", "low", "high", "root"]
    has = _read(spark, f"{path}/manifest", MANIFEST).select("part", "block", F.struct(*names).alias("has"))
    gives = manifest_rows(recipes).select("part", "block", F.struct(*names).alias("gives"))
    both = has.join(gives, ["part", "block"], "full")
    return both.select("part", "block", F.when(F.col("has").eqNullSafe(F.col("gives")), F.col("has.ids")).otherwise(F.raise_error(F.lit("the manifest doesn't match its recipes")).cast("long")).alias("ids"))


def checked_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes (RECIPE); one whose length isn't that of its chunks ends the job."""
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["n"])
    return _read(spark, f"{path}/recipes", RECIPE).withColumn("n_tokens", F.when(total == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe doesn't match its length")).cast("long")))


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, crc of every stored chunk; a payload that isn't what its digest says ends the job."""

    def run(batches):
        for batch in batches:
            digests, counts, widths, payloads = (batch.column(i) for i in range(4))
            crcs = []
            for d, n, width, payload in zip(digests.to_pylist(), counts.to_pylist(), widths.to_pylist(), payloads, strict=True):
                whole = np.frombuffer(payload.as_buffer(), f"<u{width}").astype("<u4")
                view = memoryview(whole).cast("B")
                if len(whole) != n or blake2b(view, digest_size=16).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                crcs.append(zlib.crc32(view))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    chunks = _read(spark, f"{path}/data", "kind string, digest binary, n int, width int, payload binary").where("kind = 'chunk'")
    return chunks.select("digest", "n", "width", "payload").mapInArrow(run, "digest binary, n int, crc long")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of each document, from the files."""
    recipes = checked_recipes(spark, path)
    uses = recipes.select("seq", "root", F.posexplode("chunks").alias("pos", "c")).select("seq", "root", "pos", F.col("c.digest").alias("digest"), F.col("c.n").alias("n"))
    chunks = checked_chunks(spark, path)
    found = uses.join(chunks.select("digest", F.col("n").alias("stored"), "crc"), "digest", "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", "digest", "n", "stored", "crc")))
    by_doc = found.groupBy("seq", "root").agg(listed.alias("parts"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(2)
            first = held.offsets.to_numpy()[:-1] - held.offsets[0].as_py()
            digest, n, stored, crc = (held.flatten().field(c) for c in ("digest", "n", "stored", "crc"))
            leaves, ends = digest.to_pylist(), [*first[1:].tolist(), len(digest)]
            whole = pc.all(pc.fill_null(pc.equal(n, stored), False)).as_py()
            if not whole or any(merkle(leaves[i:j]) != root for i, j, root in zip(first.tolist(), ends, batch.column(1).to_pylist(), strict=True)):
                raise ValueError("a recipe doesn't match its chunks")
            out = crc_join(crc.to_numpy(), 4 * n.to_numpy().astype(np.int64), first.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.astype(np.int64))], names=["seq", "ids_crc32"])

    crcs = by_doc.mapInArrow(run, "seq long, ids_crc32 long")
    # ids before each block of a part: one row per 1,024 recipes, then a window over parts
    blocks = checked_blocks(spark, path, recipes)
    per_part = blocks.groupBy("part").agg(F.sum("ids").alias("ids"))
    before_part = per_part.select("part", (F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before_part"))
    before = blocks.select("part", "block", F.sum("ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before_block")).join(before_part, "part")
    inside = F.sum("n_tokens").over(Window.partitionBy("part", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = recipes.withColumn("block", F.floor(F.col("seq") / 1024)).select("seq", "doc_id", "n_tokens", F.size("chunks").cast("long").alias("n_chunks"), "part", "block", inside.alias("inside")).join(before, ["part", "block"], "right")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return placed.join(crcs, "seq", "left").select("doc_id", (zero("before_part") + zero("before_block") + zero("inside")).alias("start"), "n_tokens", "ids_crc32", "n_chunks")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: every document rebuilt from its recipe, with its end id; checked like read_digests."""
    recipes = checked_recipes(spark, path)
    blocks = checked_blocks(spark, path, recipes)
    chunks = _read(spark, f"{path}/data", "kind string, digest binary, n int, width int, payload binary").where("kind = 'chunk'")
    # the ids of a block are kept, so that its check is run
    placed = recipes.withColumn("block", F.floor(F.col("seq") / 1024)).join(blocks.select("part", "block", F.col("ids").alias("block_ids")), ["part", "block"], "right")
    uses = placed.select("seq", "doc_id", "root", "n_tokens", "block_ids", F.posexplode_outer("chunks").alias("pos", "c")).select("seq", "doc_id", "root", "n_tokens", "block_ids", "pos", F.col("c.digest").alias("digest"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "digest", "width", "payload")))

    def rebuilt(n: int, root: bytes, ps: list[dict]) -> np.ndarray:
        found = [None if p["payload"] is None else np.frombuffer(p["payload"], f"<u{p['width']}").astype(np.int64) for p in ps]
        if any(x is None or digest_of(x) != p["digest"] for x, p in zip(found, ps, strict=True)):
            raise ValueError("a chunk is missing or damaged")
        ids = np.concatenate(found)
        if len(ids) != n or merkle([p["digest"] for p in ps]) != root:
            raise ValueError("a recipe doesn't match its chunks")
        return ids

    def run(batches):
        for batch in batches:
            ids = [rebuilt(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    listed = uses.join(chunks.select("digest", "width", "payload"), "digest", "left").groupBy("seq", "doc_id", "n_tokens", "root", "block_ids").agg(parts.alias("parts"))
    return listed.select("doc_id", "n_tokens", "root", "parts", "block_ids").mapInArrow(run, "doc_id long, ids array<long>")


def store_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to a new store in the shared folder and read it back."""
    path = stage_path(docs.sparkSession, "token-store")
    write_store(docs, tokenizer, path)
    return read_digests(docs.sparkSession, path)
