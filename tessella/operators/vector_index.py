"""Vector search by inverted lists: a coarse quantiser, one list a cell, exact scores of the lists that a query probes.

Cells
    Spherical k-means on a sample of at most ``SAMPLE`` vectors; at most
    ``CELLS`` centroids.  That, and nothing else, is bounded: every vector is
    assigned to the cell of its nearest centroid.

Lists
    A versioned store (sources.versions) holds centroids and lists; lists lie in
    one folder a cell, so a search opens only the folders of probed cells.
    Rows of one cell are written by several tasks, as a cell may hold many.

Search
    The cells nearest to each query are probed.  Rows of a cell meet only the
    queries that probe it, as one product of matrices a batch, and each batch
    passes on its k best a query.  Scores are exact; what lies in other cells
    isn't found, so ``recall`` measures, and ``tune`` finds the number of probes
    that reaches a recall.  Probing all cells is exact search.  Realms are
    bounds on the place of a vector, checked inside the lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import versions
from ..sources.staging import staged
from .retrieval import best_vectors, limits, nearest, question_rows, top, type_of, unit

#: Vectors that k-means learns on, and centroids.
SAMPLE, CELLS = 100_000, 4096
#: Tasks that write the rows of one cell.
WRITERS = 8


def k_means(x: np.ndarray, cells: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell takes the row that is worst served."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        score = x @ centroids.T
        own, best = score.argmax(axis=1), score.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        for j in np.flatnonzero(np.bincount(own, minlength=cells) == 0):
            worst = int(best.argmin())
            sums[j], best[worst] = x[worst], np.inf
        centroids = unit(sums)
        centroids[np.isnan(centroids).any(axis=1)] = x[0]
    return centroids


def build(spark: SparkSession, root: str, vectors: DataFrame, key: str = "chunk_key", vector: str = "embedding", place: str | None = None, cells: int | None = None, seed: int = 1) -> versions.Snapshot:
    """Write the index of vectors as the next version below root.

    Null vectors and those of no length are in no list, as they are near
    nothing; vectors of another size are an error.
    """
    own = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), (F.col(place).cast("long") if place else F.lit(0).cast("long")).alias("place"), F.col(vector).cast("array<double>").alias("v"))
    n = own.count()
    chosen = own.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(SAMPLE).select("v").toPandas()["v"] if n else []
    if len({len(v) for v in chosen}) > 1:
        raise ValueError("vectors differ in length")
    x = unit(np.array(list(chosen), float)) if n else np.zeros((0, 1))
    x = x[~np.isnan(x).any(axis=1)]
    cells = min(cells or max(1, round(n**0.5)), CELLS, len(x))
    centroids = k_means(x, cells, seed=seed) if cells else np.zeros((0, x.shape[1]))
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches):
        middle = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if (np.diff(batch.column(2).offsets.to_numpy()) != middle.shape[1]).any():
                raise ValueError("vectors differ in length")
            rows = unit(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1))
            good = ~np.isnan(rows).any(axis=1)
            kept = batch.filter(pa.array(good))
            cell = (rows[good] @ middle.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell.astype(np.int32))], names=["key", "place", "v", "cell"])

    schema = f"key {own.schema['key'].dataType.simpleString()}, place long, v array<double>, cell int"
    lists = own.mapInArrow(run, schema).repartition("cell", F.pmod(F.xxhash64("key"), F.lit(WRITERS)))
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    return versions.commit(spark, root, replace={"lists": lists, "centroids": middle}, drop={"lists": [], "centroids": []}, by={"lists": "cell"}, note={"vectors": n, "cells": cells})


def search(spark: SparkSession, index: versions.Snapshot, queries: DataFrame, k: int = 60, probes: int = 8, realms: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rank of the k nearest vectors in the probes nearest cells; queries and realms as for ``retrieval.nearest``."""
    ids, q = question_rows(queries)
    middle = index.read(spark, "centroids").orderBy("cell").toPandas()  # CELLS rows at most
    centroids = np.array(middle["centroid"].tolist(), float).reshape(len(middle), -1) if len(middle) else np.zeros((0, 0))
    near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes] if len(middle) and len(ids) else np.zeros((len(ids), 0), int)
    if len(ids) and len(middle) and q.shape[1] != centroids.shape[1]:
        raise ValueError("vectors differ in length")
    asked: dict[int, np.ndarray] = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    bounds = None if realms is None else {r["query_id"]: (r["low"], r["high"]) for r in realms.select("query_id", "low", "high").collect()}
    lists = index.read(spark, "lists").where(F.col("cell").isin(list(asked)))
    shared = spark.sparkContext.broadcast((pa.array(ids, type_of(queries)), q, asked, limits(ids, bounds)))

    def run(batches):
        names, block, probing, places = shared.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell):
                own = batch.filter(pa.array(cell == c))
                who = probing[int(c)]
                yield from best_vectors([own], names.take(pa.array(who)), block[who], None if places is None else places[who], k)

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {lists.schema['key'].dataType.simpleString()}, score double"
    return top(lists.mapInArrow(run, schema), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of exact (query_id, key) that found has too."""
    hit = exact.select("query_id", "key").join(found.select("query_id", "key").withColumn("there", F.lit(1)), ["query_id", "key"], "left")
    got = hit.agg(F.count("there"), F.count(F.lit(1))).first()
    return got[0] / got[1] if got[1] else 1.0


def tune(spark: SparkSession, index: versions.Snapshot, vectors: DataFrame, queries: DataFrame, key: str = "chunk_key", vector: str = "embedding", k: int = 60, least: float = 0.9) -> int:
    """The smallest number of probes, of a grid of twentieths of the cells, whose recall on queries is least or more."""
    cells = index.note["cells"]
    exact = staged(nearest(vectors, queries, key, vector, k), "exact")
    low, high = 1, 20
    while low < high:  # recall grows with probes
        mid = (low + high) // 2
        if recall(search(spark, index, queries, k, max(1, -(-cells * mid // 20))), exact) >= least:
            high = mid
        else:
            low = mid + 1
    return max(1, -(-cells * low // 20))
