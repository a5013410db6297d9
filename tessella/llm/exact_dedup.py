"""Exact dedup by deterministic block naming.  DataFrame functions only.

Method
    Each run of white space becomes one blank and the text is cut into blocks
    of ``BLOCK_CHARS`` characters.  Blocks are dealt by hash into ``BUCKETS``
    buckets and sorted inside them; the name of a block is its bucket and its
    dense rank there, one integer, so equal blocks and only they share a name,
    whatever their hashes do.  Then adjacent pairs of names are named the same
    way, again and again, until one name is left of each document.  Names of
    different numbers of blocks are told apart by that number.

Skew
    A block (or pair) that very many documents share is found by counting its
    hash first, with partial counts.  There can be at most ``HOT_PARTS`` such
    hashes, as each has over 1/HOT_PARTS of all rows; their distinct contents
    are aggregated with partial aggregation, named apart (below zero) and
    joined back by broadcast, so their rows never meet in one task.

Defined cases
    Null text counts as empty.  Repeated rows (same doc_id and text) are
    documents of their own and come out as many times; one of them is kept.
    Null doc_id sorts first among equals.  Empty table: no rows.  Extra columns
    are ignored by ``duplicates`` and kept by ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE_RUN, free_name, stage

BLOCK_CHARS = 8192
BUCKETS = 1 << 20
HOT_PARTS = 64
RANK_BITS = 40


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def name_values(rows: DataFrame, values: list[str], name: str) -> DataFrame:
    """rows without values and with name: a long that equal values, and only they, share.

    rows has to be stored: it is read up to three times.
    """
    rest = [c for c in rows.columns if c not in values]
    hashed = rows.withColumn("__h", F.xxhash64(*values))
    counts = hashed.groupBy("__h").count()
    total = rows.count()
    hot = [r["__h"] for r in counts.where(F.col("count") > max(total // HOT_PARTS, 16)).collect()]  # HOT_PARTS rows at most
    is_hot = F.col("__h").isin(hot) if hot else F.lit(False)
    bucket = F.pmod("__h", F.lit(BUCKETS))
    rank = F.dense_rank().over(Window.partitionBy("__b").orderBy(*values)).cast("long")
    cold = hashed.where(~is_hot).withColumn("__b", bucket).withColumn(name, F.shiftleft(F.col("__b"), RANK_BITS) + rank).select(*rest, name)
    if not hot:
        return cold
    few = hashed.where(is_hot).select("__h", *values).distinct()
    named = few.withColumn("__r", F.dense_rank().over(Window.partitionBy("__h").orderBy(*values)).cast("long"))
    index = F.lit(0).cast("long")
    for i, h in enumerate(sorted(hot)):
        index = F.when(F.col("__h") == F.lit(h), F.lit(i + 1).cast("long")).otherwise(index)
    named = named.select(*values, (-(F.shiftleft(index, RANK_BITS) + F.col("__r"))).alias(name))
    warm = hashed.where(is_hot).join(F.broadcast(named), values).select(*rest, name)
    return cold.unionByName(warm)


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text_sha256, n_blocks, identity, copies: equal (n_blocks, identity) means equal texts.

    copies counts the rows with this doc_id and text.
    """
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
    keyed = norm.withColumn("n_blocks", F.greatest(F.ceil(F.length("t") / F.lit(block_chars)), F.lit(1)).cast("int")).withColumn("text_sha256", F.sha2("t", 256))
    starts = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    cut = keyed.select("doc_id", "text_sha256", "n_blocks", F.posexplode(F.transform(starts, lambda i: F.substring("t", i * block_chars + 1, F.lit(block_chars)))).alias("pos", "block"))
    named = stage(name_values(stage(cut, "blocks"), ["block"], "name"), "names")
    # repeated rows of one document hold the same names
    level = stage(named.groupBy("doc_id", "text_sha256", "n_blocks", "pos").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies")), "level")
    done = level.where("n_blocks = 1").select("doc_id", "text_sha256", "n_blocks", F.col("name").alias("identity"), "copies")
    open_ = level.where("n_blocks > 1")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    width = 1
    while width < most:
        even = F.col("pos") % 2 == 0
        pairs = open_.groupBy("doc_id", "text_sha256", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right"), F.max("copies").alias("copies"))
        # RIGHT of an odd one out: a name that no block has
        pairs = pairs.withColumn("right", F.coalesce("right", F.lit(0).cast("long")))
        width *= 2
        open_ = stage(name_values(stage(pairs, "pairs"), ["left", "right"], "name"), "level")
        done = done.unionByName(open_.where(F.col("n_blocks") <= width).select("doc_id", "text_sha256", "n_blocks", F.col("name").alias("identity"), "copies"))
        open_ = open_.where(F.col("n_blocks") > width)
    return done


def duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs."""
    own = stage(identities(docs, block_chars), "identities")
    # stored, as a join with an aggregate of the same rows isn't split where it is skewed
    groups = stage(own.groupBy("n_blocks", "identity").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"), F.sum("copies").alias("group_size")), "groups")
    found = own.join(groups, ["n_blocks", "identity"])
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    is_first = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", is_first.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The first row of each group of equal texts, with all columns of docs.

    Of repeated rows (same doc_id and text) one stays.
    """
    keep_id, keep_sha, sha, rank = (free_name(docs, c) for c in ("__keep_id", "__keep_sha", "__sha", "__rank"))
    kept = duplicates(docs, block_chars).where("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha))
    digest = F.sha2(normalised(F.col("text")), 256)
    joined = docs.withColumn(sha, digest).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)) & (F.col(sha) == F.col(keep_sha)))
    one = Window.partitionBy(keep_id, keep_sha).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"], F.col("text"))
    return joined.withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
