"""Mixing sources to target weights.  DataFrame functions only.

Targets
    Sources in order of their code points, null last, get ``weights`` in turn
    and share ``share`` of all words in proportion to them; a source's target
    stops at ``max_epochs`` times its size.  Water-filling: with the sources in
    order of cap over weight, those up to some place are at their cap and the
    others get one common level times their weight; the place is the first at
    which no other source is above its cap.  That is where repeated resharing
    of the excess ends.

Sampling
    A document is taken floor(target / size of source) times, and once more if
    it is in the fractional part: its source's documents in the order of a
    seeded hash, up to what is still wanted, the last one if at least half of
    it is.  Running sums go over ``PARTS`` ranges of the hash first, so only
    the one range in which the sum is reached is looked at by document, and a
    source with a third of all rows is spread over all ranges.

Bounds
    One row per source and hash range is ordered in one place per source; the
    table of sources (one row each, pre-aggregated) is ordered as a whole.

Defined cases
    Null or empty text: size 0, taken 0.  Source without words: target 0.
    Repeated rows: each is sampled, ties in (hash, doc_id, size) are alike.
    Null doc_id: hashed as "null".  Null source: a source of its own, the last.
    Empty table: no rows.  Extra columns are ignored by ``mix`` and kept by
    ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, free_name, stage, unit_hash

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, 20240
PARTS = 1024
HASH_BITS = 48


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size)."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(place % len(weights) == i, F.lit(float(w))).otherwise(weight)
    base = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    level = (F.sum("source_size").over(total) * F.lit(share) - zero(F.sum("cap").over(before))) / (F.sum("weight").over(total) - zero(F.sum("weight").over(before)))
    steps = base.withColumn("level", level)
    # the first place whose level no later cap is below; none: all are at their caps
    reached = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(total)
    return steps.withColumn("reached", reached["level"]).select("source", "source_size", F.when(F.col("reached").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("reached") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken of each row of docs."""
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix_sizes(sized, weights, share, max_epochs, seed)


def mix_sizes(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``mix`` for a stored table of doc_id, source and size."""
    drawn = sized.withColumn("u", unit_hash("doc_id", seed=seed)).withColumn("part", F.shiftright("u", HASH_BITS - PARTS.bit_length() + 1).cast("int"))
    parts = stage(drawn.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts")
    wanted = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    wanted = wanted.withColumn("whole", whole.cast("long")).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s")
    running = F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    plan = parts.withColumn("before", F.coalesce(running, F.lit(0))).join(wanted, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("part").alias("p"), "before", "part_size", "source_size", "target", "whole", "more")
    known = drawn.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    all_in, none_in = F.col("before") + F.col("part_size") <= F.col("more"), F.col("before") >= F.col("more")
    clear = known.where(all_in | none_in).withColumn("extra", (all_in & (F.col("more") > 0)).cast("long"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = known.where(~(all_in | none_in)).withColumn("extra", (F.col("before") + inside + F.col("size") / 2 <= F.col("more")).cast("long"))
    both = clear.unionByName(edge).withColumn("times", F.col("whole") + F.col("extra"))
    return both.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns.

    Rows alike in doc_id, source and size are taken as often as each other in
    order of the rest of their columns.
    """
    a, size, rank, own_id, own_source, own_size = (free_name(docs, c) for c in ("__times", "__size", "__rank", "__own_id", "__own_source", "__own_size"))
    sized = docs.withColumn(size, n_words(F.col("text")))
    found = mix_sizes(stage(sized.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(size).alias("size")), "sizes"), weights, share, max_epochs, seed)
    counted = found.groupBy("doc_id", "source", "size").agg(F.array_sort(F.collect_list("times")).alias("t")).select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size), F.col("t").alias(a))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (F.col(size) == F.col(own_size))
    joined = sized.join(counted.where(F.array_max(a) > 0), same)
    alone = joined.where(F.size(a) == 1).withColumn(rank, F.lit(1))
    order = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
    several = joined.where(F.size(a) > 1).withColumn(rank, F.row_number().over(order))
    times = F.element_at(F.col(a), F.col(rank))
    out = alone.unionByName(several).withColumn(rank, times).where(F.col(rank) > 0)
    return out.withColumn(rank, F.explode(F.array_repeat(F.lit(0), F.col(rank).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
