"""Hybrid retrieval for a batch of queries: BM25, vectors, fusion, assembly.

Queries are a stated small set; everything else may be large.  Rankings are
windows over the query id, for which Spark keeps the first k of every task
before it shuffles (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import reciprocal_rank
from ..functions.text import normalize_query, tokens
from ..sources.staging import staged

#: From a text to its tokens, such as ``text.tokens`` or a ``segment.segmenter``.
Tokenizer = Callable[[Column], Column]
K1, B = 1.5, 0.75
DECIMALS = 9


def document_frequencies(chunks: DataFrame, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """token, df over all chunks."""
    return chunks.select(F.explode(F.array_distinct(tokenizer(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


#: Queries that a batch of chunks is multiplied with at a time.
WORD_BLOCK, QUERY_BLOCK = 256, 2048
#: What is worked on at a time of a batch, whatever its rows hold: tokens, and scores.
TOKEN_SLICE, SCORE_SLICE = 200_000, 1_000_000
#: What all queries of one call may hold: numbers of their vectors, and tokens of their questions.
MAX_NUMBERS, MAX_TOKENS = 32_000_000, 4_000_000


def postings(chunks: DataFrame, vocabulary: list[str], key: str, text: str, place: str | None = None, tokenizer: Tokenizer = tokens) -> DataFrame:
    """key, place, dl, tokens, tfs of every chunk: its length, and which tokens of the vocabulary (by number) it holds how often."""
    own = chunks.select(F.col(key).alias("key"), (F.col(place).cast("long") if place else F.lit(0).cast("long")).alias("place"), tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    names = pa.array(vocabulary, pa.string())

    def run(batches):
        for batch in batches:
            for own in token_slices(batch, 2, TOKEN_SLICE):
                ts = own.column(2)
                dl = np.diff(ts.offsets.to_numpy())
                found = pc.fill_null(pc.index_in(ts.flatten(), value_set=names), -1).to_numpy().astype(np.int64)
                row, inside = np.repeat(np.arange(len(dl)), dl), found >= 0
                code, tf = np.unique(row[inside] * (len(names) + 1) + found[inside], return_counts=True)
                ends = np.append(0, np.cumsum(np.bincount(code // (len(names) + 1), minlength=len(dl)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (code % (len(names) + 1), tf)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(dl.astype(np.int32)), *lists], names=["key", "place", "dl", "tokens", "tfs"])

    return own.mapInArrow(run, f"key {own.schema['key'].dataType.simpleString()}, place long, dl int, tokens array<int>, tfs array<int>")


def token_slices(batch: pa.RecordBatch, column: int, tokens: int):
    """The rows of a batch in order, in slices whose lists in a column hold so many tokens or are one row."""
    ends, at = batch.column(column).offsets.to_numpy(), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + tokens, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "chunk_key", text: str = "content", k: int = 60, allowed: DataFrame | None = None, place: str | None = None, realms: DataFrame | None = None, tokenizer: Tokenizer = tokens) -> DataFrame:
    """query_id, key, score, rank of the k best chunks of each query.

    queries: query_id, question; they are the stated small side, MAX_TOKENS
    tokens in all, beyond which the call is refused.  Statistics are of all
    chunks; a token that a question repeats counts repeatedly; ties go to the
    smaller key.  allowed
    (key) leaves only those chunks in the ranking, scored as without it;
    without rows nothing is found.  realms (query_id, low, high) does so for
    each query by the chunks' place; a query without one finds nothing.

    Chunks are tokenised once and stored with the asked tokens only.  A batch
    of them is multiplied, a few rows at a time, with the weights of WORD_BLOCK
    queries at most and passes on what may be among its k best a query, ties
    included, so pairs of queries and chunks are never shuffled.
    """
    asked: dict = {}
    counted = queries.select("query_id", F.explode(tokenizer(F.col("question"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.limit(MAX_TOKENS + 1).collect()
    if len(rows) > MAX_TOKENS:
        raise ValueError(f"questions of more than {MAX_TOKENS} tokens: ask in several calls")
    for r in rows:
        asked.setdefault(r["query_id"], {})[r["token"]] = r["n"]
    vocabulary = sorted({t for own in asked.values() for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    held = staged(postings(chunks, vocabulary, key, text, place, tokenizer), "postings")
    size = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    df = np.zeros(len(vocabulary))
    for r in held.select(F.explode("tokens").alias("t")).groupBy("t").count().collect():  # a row for each asked token at most
        df[r["t"]] = r["count"]
    idf = np.log(1 + (size["n"] - df + 0.5) / (df + 0.5))
    bounds = None if realms is None else {r["query_id"]: (r["low"], r["high"]) for r in realms.select("query_id", "low", "high").collect()}
    live = held if allowed is None else held.join(allowed.select("key"), "key", "left_semi").select(*held.columns)
    ids = sorted(asked)
    # each query's tokens and weights in a row
    token = np.array([number[t] for q in ids for t in asked[q]], np.int64)
    weight = np.array([n * idf[number[t]] for q in ids for t, n in asked[q].items()], float)
    ends = np.cumsum([len(asked[q]) for q in ids], dtype=np.int64)
    shared = held.sparkSession.sparkContext.broadcast((pa.array(ids, type_of(queries)), token, weight, ends, size["avgdl"] or 1.0, limits(ids, bounds)))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {held.schema['key'].dataType.simpleString()}, score double"
    return top(live.mapInArrow(lambda batches: best_words(batches, *shared.value, k), schema), k)


def type_of(queries: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(queries.schema["query_id"].dataType)


def limits(ids: list, bounds: dict | None) -> np.ndarray | None:
    """Lowest and highest place of each query; a query without any has none."""
    return None if bounds is None else np.array([bounds.get(q, (1, 0)) for q in ids], np.int64).reshape(-1, 2)


def word_blocks(ends: np.ndarray) -> list[tuple[int, int]]:
    """Queries from and to, for so many at a time that their tokens times their number stay within MAX_TOKENS."""
    blocks, at = [], 0
    while at < len(ends):
        own = (ends[at : at + WORD_BLOCK] - (ends[at - 1] if at else 0)) * np.arange(1, len(ends[at : at + WORD_BLOCK]) + 1)
        to = at + max(1, int(np.searchsorted(own, MAX_TOKENS, side="right")))
        blocks.append((at, to))
        at = to
    return blocks


def row_slices(batch: pa.RecordBatch, numbers: int, most: int):
    """The rows of a batch in order, most at a time or so many that SCORE_SLICE numbers come of them, at so many a row."""
    rows = max(1, min(most, SCORE_SLICE // max(numbers, 1)))
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def best_words(batches, ids: pa.Array, token: np.ndarray, weight: np.ndarray, ends: np.ndarray, avgdl: float, places: np.ndarray | None, k: int, rows: int = 512):
    """query_id, key, score of the best of each batch of postings; one block of weights is held at a time."""
    for batch in batches:
        for at, to in word_blocks(ends):
            low, high = (int(ends[at - 1]) if at else 0), int(ends[to - 1])
            used, column = np.unique(token[low:high], return_inverse=True)
            weights = np.zeros((len(used), to - at))
            weights[column, np.searchsorted(ends[at:to], np.arange(low, high), side="right")] = weight[low:high]
            best = np.full((max(k, 1), to - at), -np.inf)
            for own in row_slices(batch, max(len(used), to - at), rows):
                row = np.repeat(np.arange(own.num_rows), np.diff(own.column(3).offsets.to_numpy()))
                held, tf = own.column(3).flatten().to_numpy(), own.column(4).flatten().to_numpy().astype(float)
                norm = (K1 * (1 - B + B * own.column(2).to_numpy() / avgdl))[row]
                column = np.minimum(np.searchsorted(used, held), len(used) - 1)
                inside = used[column] == held
                dense = np.zeros((own.num_rows, len(used)))
                dense[row[inside], column[inside]] = (tf / (tf + norm))[inside]
                yield best_rows(ids.slice(at, to - at), own.column(0), np.round(dense @ weights, DECIMALS), 0.0, own.column(1).to_numpy(), None if places is None else places[at:to], best)


def best_rows(ids: pa.Array, keys: pa.Array, score: np.ndarray, above: float, at: np.ndarray, places: np.ndarray | None, best: np.ndarray) -> pa.RecordBatch:
    """The keys of each query with a score above a bound that may be among the best, ties with the last one included.

    best: the best scores of each query before these rows, which are brought up to date.
    """
    score[np.isnan(score)] = -np.inf
    if places is not None:
        score[(at[:, None] < places[None, :, 0]) | (at[:, None] > places[None, :, 1])] = -np.inf
    best[:] = np.partition(np.concatenate([best, score]), -len(best), axis=0)[-len(best) :]
    q, row = np.nonzero(((score >= best[0]) & (score > above)).T)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), keys.take(pa.array(row)), pa.array(score[row, q])], names=["query_id", "key", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "chunk_key", vector: str = "embedding", k: int = 60, where: Column | None = None, place: str | None = None, realms: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rank of the k nearest vectors; filters come before the ranking, realms as for ``bm25``.

    Queries are the stated small side, MAX_NUMBERS numbers in all, beyond which
    the call is refused.  A batch of vectors is multiplied, a few rows at a
    time, with QUERY_BLOCK of them at once and passes on what may be among its k
    best a query, ties included.  Vectors of no length are near nothing; vectors
    of another size are an error.
    """
    known = vectors.where(F.col(vector).isNotNull())
    known = (known.where(where) if where is not None else known).select(F.col(key).alias("key"), (F.col(place).cast("long") if place else F.lit(0).cast("long")).alias("place"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {known.schema['key'].dataType.simpleString()}, score double"
    ids, block = question_rows(queries)
    bounds = None if realms is None else {r["query_id"]: (r["low"], r["high"]) for r in realms.select("query_id", "low", "high").collect()}
    shared = known.sparkSession.sparkContext.broadcast((pa.array(ids, type_of(queries)), block, limits(ids, bounds)))
    return top(known.mapInArrow(lambda batches: best_vectors(batches, *shared.value, k), schema), k)


def question_rows(queries: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of the queries (query_id, vector) that have one; too many are refused."""
    own = queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).where("q is not null")
    numbers = own.agg(F.sum(F.size("q"))).first()[0] or 0
    if numbers > MAX_NUMBERS:
        raise ValueError(f"queries of {numbers} numbers, more than {MAX_NUMBERS}: ask in several calls")
    rows = own.collect()
    if len({len(r["q"]) for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    return [r["query_id"] for r in rows], unit(np.array([r["q"] for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 0)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; of no length stay without direction (not a number)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def best_vectors(batches, ids: pa.Array, block: np.ndarray, places: np.ndarray | None, k: int):
    """query_id, key, score of the best of each batch (key, place, v), from SCORE_SLICE scores at a time."""
    for batch in batches:
        if not batch.num_rows or not len(block):
            continue
        if (np.diff(batch.column(2).offsets.to_numpy()) != block.shape[1]).any():
            raise ValueError("vectors differ in length")
        for at in range(0, len(block), QUERY_BLOCK):
            asked = block[at : at + QUERY_BLOCK]
            best = np.full((max(k, 1), len(asked)), -np.inf)
            for own in row_slices(batch, max(asked.shape), batch.num_rows):
                rows = unit(own.column(2).flatten().to_numpy().reshape(own.num_rows, -1))
                yield best_rows(ids.slice(at, QUERY_BLOCK), own.column(0), np.round(rows @ asked.T, DECIMALS), -np.inf, own.column(1).to_numpy(), None if places is None else places[at : at + QUERY_BLOCK], best)


def top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(*channels: DataFrame, k: int = 60) -> DataFrame:
    """query_id, key, score, best_rank, sources, rank by reciprocal rank fusion.

    Channels in order; a key twice in a channel counts once, with its best rank.
    """
    rows = None
    for i, c in enumerate(channels):
        one = c.groupBy("query_id", "key").agg(F.min("rank").alias("r")).withColumn("channel", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    parts = F.array_sort(F.collect_list(F.struct("channel", "r")))
    got = rows.groupBy("query_id", "key").agg(parts.alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + reciprocal_rank(p["r"], k))
    seen = F.transform("parts", lambda p: p["channel"] * 1_000_000 + p["r"])
    got = got.select("query_id", "key", F.round(score, 12).alias("score"), F.array_min(F.col("parts.r")).alias("best_rank"), F.array_min(seen).alias("seen"), F.col("parts.channel").alias("sources"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "seen", "key")
    return got.withColumn("rank", F.row_number().over(order)).drop("seen")


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, realms: DataFrame, k: int = 60, pool: int = 32, out: int = 24, scorer=None, expand: bool = True, errors: str = "raise", **caps: int) -> DataFrame:
    """query_id, stage, key, rank, score, reason, source, place of a whole retrieval: every stage's rows.

    chunks: key, chapter, chunk_index, content, tokens.  vectors: key,
    embedding, chapter.  queries: query_id, question, vector; the question is
    normalised, and one that is empty then ends the job.  realms: query_id,
    low, high, both inclusive; a query without one finds nothing.  Stages:
    keyword and dense inside the realm (keyword scores from statistics of all
    chunks), fused, reranked (the first pool of them by scorer, a
    ``models.Score``; a hash where none is given) and assembled: hits and
    neighbours with their source, place in the context, or the reason why they
    are left out; the realm is checked again here, whatever a channel returned.
    With errors="rows" a query whose scorer fails has a row of the stage failed
    with the error as reason, and nothing assembled.
    """
    from .models import hash_scores, rerank_groups

    line = normalize_query(F.col("question"))
    asked = queries.withColumn("question", F.when(F.coalesce(line, F.lit("")) == "", F.raise_error(F.concat(F.lit("empty question: "), F.col("query_id").cast("string"))).cast("string")).otherwise(line))
    asked = staged(asked.select("query_id", "question", "vector"), "questions")
    # stages are read several times: each is stored once
    words = staged(bm25(chunks, asked.select("query_id", "question"), "key", "content", k, place="chapter", realms=realms), "keyword")
    every = staged(nearest(vectors, asked, "key", "embedding", k, place="chapter", realms=realms), "dense")
    fused = staged(fuse(every, words), "fused")
    texts = chunks.select("key", "content", "chapter", "chunk_index", "tokens")
    ranked = fused.where(F.col("rank") <= pool).join(asked.select("query_id", "question"), "query_id").join(texts, "key")
    scored = rerank_groups(ranked.select("query_id", "key", "rank", "question", "content"), scorer or hash_scores, pool, out, errors)
    scored = staged(scored.join(texts.drop("content"), "key", "left"), "reranked")
    second = scored.where("error is null")
    last = settled(second, texts, realms, expand, **caps)
    none = lambda kind: F.lit(None).cast(kind)
    stage = lambda df, name: df.select("query_id", F.lit(name).alias("stage"), "key", F.col("rank").cast("long").alias("rank"), F.col("score").cast("double").alias("score"), none("string").alias("reason"), none("string").alias("source"), none("long").alias("place"))
    failed = scored.where("error is not null").select("query_id", F.lit("failed").alias("stage"), "key", none("long").alias("rank"), none("double").alias("score"), F.col("error").alias("reason"), none("string").alias("source"), none("long").alias("place"))
    done = last.select("query_id", F.lit("assembled").alias("stage"), "key", F.col("rank").cast("long").alias("rank"), none("double").alias("score"), "reason", "source", F.col("place").cast("long").alias("place"))
    return stage(words, "keyword").unionByName(stage(every, "dense")).unionByName(stage(fused, "fused")).unionByName(stage(second, "reranked")).unionByName(failed).unionByName(done)


# Reasons for what assembly leaves out.
CHAPTER_CAP, CHUNK_CAP, TOP_CAP, REALM, BUDGET = "chapter_cap", "chapter_chunk_cap", "top_k_cap", "realm", "token_budget"


def assemble(hits: DataFrame, chapters: int = 8, per_chapter: int = 4, top_k: int = 12, budget: int = 6000, known_best: bool = False) -> DataFrame:
    """hits (query_id, key, chapter, rank, tokens, in_realm) with kept and reason.

    In this order: out of realm, chapters beyond the first by their best rank,
    rows beyond a chapter's cap, rows beyond top_k, and from the worst rank up
    what doesn't fit the budget.  Rows whose realm is unknown (null) aren't out
    of it; with known_best they don't make their chapter's best rank.
    """
    # what is out of realm or in a chapter too many doesn't count inside its chapter, so two orders do: by chapter and rank, then by rank
    q, by, upto = Window.partitionBy("query_id"), Window.partitionBy("query_id", "chapter"), (Window.unboundedPreceding, 0)
    live = F.col("reason").isNull()
    step = hits.withColumn("reason", F.when(~F.col("in_realm"), REALM))
    step = step.withColumn("i", F.sum(F.when(live, 1).otherwise(0)).over(by.orderBy("rank", "key").rowsBetween(*upto)))
    step = step.withColumn("best", F.min(F.when(F.col("in_realm") if known_best else live, F.col("rank"))).over(by))
    # the best rank of the last chapter that is admitted; null: there are fewer
    step = step.withColumn("last", F.get(F.array_sort(F.collect_set("best").over(q)), F.lit(chapters - 1)))
    beyond = F.col("last").isNotNull() & (F.col("best").isNull() | (F.col("best") > F.col("last"))) if chapters > 0 else F.lit(True)
    step = step.withColumn("reason", F.when(live & beyond, CHAPTER_CAP).when(live & (F.col("i") > per_chapter), CHUNK_CAP).otherwise(F.col("reason"))).drop("i", "best", "last")
    order = q.orderBy("rank", "key").rowsBetween(*upto)
    step = step.withColumn("n", F.sum(F.when(live, 1).otherwise(0)).over(order)).withColumn("reason", F.when(live & (F.col("n") > top_k), TOP_CAP).otherwise(F.col("reason")))
    held = F.sum(F.when(live, F.col("tokens")).otherwise(0)).over(order)
    step = step.withColumn("n", held).withColumn("reason", F.when(live & (F.col("n") > budget), BUDGET).otherwise(F.col("reason")))
    return step.select("query_id", "key", "chapter", "rank", F.col("reason").isNull().alias("kept"), "reason")


def settled(hits: DataFrame, chunks: DataFrame, realms: DataFrame | None = None, expand: bool = True, chapters: int = 8, per_chapter: int = 4, top_k: int = 12, budget: int = 6000) -> DataFrame:
    """Hits and the neighbours they bring, with the reason of what is left out (null: kept) and the place of what is kept.

    hits: query_id, key, chapter, chunk_index, rank, tokens.  chunks: key,
    chapter, chunk_index, tokens.  Result: query_id, key, chapter, chunk_index,
    rank, tokens, source, from_key, reason, place.

    In this order: out of realm (query_id, low, high), chapters beyond the
    first by best rank, hits beyond a chapter's cap; a chapter with fewer hits
    brings the chunk before its best hit, else the one after, in that hit's
    rank; rows beyond top_k; the realm again; hits from the worst rank up that
    don't fit the budget, each with its neighbour, then neighbours.  place
    counts by chapter and chunk_index.
    """
    one_realm = F.lit(True) if realms is None else F.coalesce(F.col("chapter").between(F.col("low"), F.col("high")), F.lit(False))
    rows = hits.select("query_id", "key", "chapter", "chunk_index", "rank", "tokens")
    if realms is not None:
        rows = rows.join(realms.select("query_id", "low", "high"), "query_id", "left")
    # all windows below lie within a query: one shuffle, also for what the neighbours come from
    rows = rows.repartition("query_id")
    live = F.col("reason").isNull()
    q, by = Window.partitionBy("query_id"), Window.partitionBy("query_id", "chapter")
    upto = (Window.unboundedPreceding, 0)
    step = rows.withColumn("reason", F.when(~one_realm, REALM)).withColumn("best", F.min(F.when(live, F.col("rank"))).over(by))
    step = step.withColumn("nth", F.dense_rank().over(q.orderBy(F.col("best").asc_nulls_last())))
    step = step.withColumn("reason", F.when(live & (F.col("nth") > chapters), CHAPTER_CAP).otherwise(F.col("reason")))
    step = step.withColumn("i", F.sum(F.when(live, 1).otherwise(0)).over(by.orderBy("rank", "key").rowsBetween(*upto)))
    step = step.withColumn("reason", F.when(live & (F.col("i") > per_chapter), CHUNK_CAP).otherwise(F.col("reason")))
    keep = [c for c in rows.columns]
    kind = hits.schema["key"].dataType
    both = step.select(*keep, "reason", F.lit("hit").alias("source"), F.lit(None).cast(kind).alias("from_key"))
    if expand:
        taken = step.withColumn("taken", F.collect_set(F.when(live, F.col("chunk_index"))).over(by))  # per_chapter at most
        wish = F.explode(F.array(*[F.struct((F.col("chunk_index") + d).alias("chunk_index"), F.lit(d).alias("d")) for d in (-1, 1)])).alias("w")
        wished = taken.where(live & (F.col("i") == 1) & (F.size("taken") < per_chapter)).select(*[c for c in keep if c not in ("key", "chunk_index", "tokens")], F.col("key").alias("from_key"), "taken", wish)
        wished = wished.select("*", F.col("w.chunk_index").alias("chunk_index"), F.col("w.d").alias("d")).where(~F.array_contains("taken", F.col("chunk_index"))).drop("w", "taken")
        found = wished.join(chunks.select("key", "chapter", "chunk_index", "tokens"), ["chapter", "chunk_index"])
        rest = [c for c in keep if c not in ("query_id", "key", "chunk_index", "tokens")]
        near = found.groupBy("query_id", "from_key", *rest).agg(F.min_by(F.struct("key", "chunk_index", "tokens"), "d").alias("n"))
        near = near.select("query_id", "n.key", "n.chunk_index", "n.tokens", *rest, F.lit(None).cast("string").alias("reason"), F.lit("neighbor").alias("source"), "from_key")
        both = both.unionByName(near.select(*both.columns))
    order = q.orderBy("rank", "source", "key")
    hit = F.col("source") == "hit"
    cut = both.withColumn("n", F.sum(F.when(live, 1).otherwise(0)).over(order.rowsBetween(*upto)))
    cut = cut.withColumn("reason", F.when(live & (F.col("n") > top_k), TOP_CAP).when(live & ~one_realm, REALM).otherwise(F.col("reason")))
    held = F.sum(F.when(live & hit, F.col("tokens")).otherwise(0)).over(order.rowsBetween(*upto))
    cut = cut.withColumn("held", held).withColumn("reason", F.when(live & (F.col("held") > budget), BUDGET).otherwise(F.col("reason")))
    extra = F.sum(F.when(live & ~hit, F.col("tokens")).otherwise(0)).over(order.rowsBetween(*upto))
    cut = cut.withColumn("all_hits", F.sum(F.when(live & hit, F.col("tokens")).otherwise(0)).over(q)).withColumn("extra", extra)
    cut = cut.withColumn("reason", F.when(live & ~hit & (F.col("all_hits") + F.col("extra") > budget), BUDGET).otherwise(F.col("reason")))
    place = F.when(live, F.row_number().over(Window.partitionBy("query_id", live).orderBy("chapter", "chunk_index", "key")))
    return cut.withColumn("place", place).select("query_id", "key", "chapter", "chunk_index", "rank", "tokens", "source", "from_key", "reason", "place")


def assemble_context(hits: DataFrame, chunks: DataFrame, chapters: int = 8, per_chapter: int = 4, top_k: int = 12, budget: int = 6000, realms: DataFrame | None = None) -> DataFrame:
    """The context of each query, neighbours included, as ``settled`` keeps it: query_id, place, key, chapter, chunk_index, source, from_key, rank, tokens."""
    kept = settled(hits, chunks, realms, True, chapters, per_chapter, top_k, budget).where("reason is null")
    return kept.select("query_id", "place", "key", "chapter", "chunk_index", "source", "from_key", "rank", "tokens")
