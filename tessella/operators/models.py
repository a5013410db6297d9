"""Models as plain callables over batches, and stand-ins that need none.

A model is a picklable function of lists; Spark gives it a batch of texts at a
time.  Each batch's answers are checked: as many as asked for, finite, of the
promised dimension.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.numbers import hash_score

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]
#: A question and the texts of its pool: (index of a text, score), in any order.
Score = Callable[[str, list[str]], list[tuple[int, float]]]


def hash_vectors(texts: list[str], dim: int = 64, tag: str = "stand-in") -> list[list[float]]:
    """Unit vectors from the text's hash: big-endian 32-bit numbers scaled to [-1, 1)."""
    out = []
    for t in texts:
        raw = hashlib.shake_256(f"{tag}\n{t}".encode("utf-8", "surrogatepass")).digest(4 * dim)
        v = np.frombuffer(raw, ">u4").astype(np.float64) / 2**31 - 1
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def embed(text: Column, model: Embed = hash_vectors, dim: int = 64, batch: int = 10) -> Column:
    """Vectors of texts (null: null), batch texts a call."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        asked = [t for t in own if t is not None]
        got: list[list[float]] = []
        for i in range(0, len(asked), batch):
            part = asked[i : i + batch]
            answer = model(part)
            if len(answer) != len(part) or any(len(v) != dim or not all(map(math.isfinite, v)) for v in answer):
                raise ValueError("the model returned another number of vectors, another dimension or no numbers")
            got += answer
        each = iter(got)
        return pa.array([None if t is None else next(each) for t in own], pa.list_(pa.float64()))

    return run(text)


def backfill(chunks: DataFrame, key: str = "chunk_key", text: str = "content", vector: str = "embedding", model: Embed = hash_vectors, dim: int = 64, limit: int | None = None) -> DataFrame:
    """New vectors (key, embedding) of the chunks that have none; limit takes the first keys, so a run can go on where one stopped."""
    todo = chunks.where(F.col(vector).isNull()).select(key, text)
    if limit is not None:
        todo = todo.orderBy(key).limit(limit)
    return todo.select(key, embed(F.col(text), model, dim).alias(vector))


def rerank(pool: DataFrame, score: Column | None = None, pool_k: int = 32, out: int = 24) -> DataFrame:
    """The best out of each query's first pool_k fused rows (query_id, key, rank, question, content).

    score is a column over these; without one, a hash of question and content.
    Order: score, then the place in the pool.
    """
    score = hash_score(F.col("question"), F.col("content")) if score is None else score
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank")
    rows = pool.where(F.col("rank") <= pool_k).select("query_id", "key", F.col("rank").alias("fused_rank"), score.alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= out)


def hash_scores(question: str, texts: list[str]) -> list[tuple[int, float]]:
    """Scores in [0, 1) from a hash of question and text."""
    hashed = (hashlib.sha256(f"{question}\n{t}".encode("utf-8", "surrogatepass")).digest()[:8] for t in texts)
    return [(i, int.from_bytes(h, "big") / 2**64) for i, h in enumerate(hashed)]


def rerank_groups(pool: DataFrame, model: Score = hash_scores, pool_k: int = 32, out: int = 24, errors: str = "raise") -> DataFrame:
    """query_id, key, fused_rank, score, rank, error: the best out of each query's first pool_k rows (query_id, key, rank, question, content).

    The model sees a query's whole pool, in the order of rank, and names texts
    by their index.  Here the order is restored (score, then index), a repeated
    index counts once, and an index outside the pool or a score that is no
    number is the model's failure, as is anything that it raises.  A failure
    ends the job, or with errors="rows" is the query's only row, without key.
    A query without pool isn't asked about.
    """
    if out <= 0 or pool_k <= 0:
        raise ValueError("pool and result need a place at least")
    if errors not in ("raise", "rows"):
        raise ValueError("errors is raise or rows")

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("rank")
        query, keys, places = rows["query_id"][:1], rows["key"].combine_chunks(), rows["rank"].combine_chunks()
        try:
            answer = [(int(i), float(s)) for i, s in model(rows["question"][0].as_py(), rows["content"].to_pylist())]
            if any(not 0 <= i < len(keys) or not math.isfinite(s) for i, s in answer):
                raise ValueError("the model named a text that isn't there, or gave no number")
        except Exception as e:
            if errors == "raise":
                raise
            none = pa.nulls(1)
            return pa.Table.from_arrays([query.combine_chunks(), none.cast(keys.type), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.int64()), pa.array([f"{type(e).__name__}: {e}"])], names=names)
        best: dict[int, float] = {}
        for i, s in sorted(answer, key=lambda x: (-x[1], x[0])):
            best.setdefault(i, s)
        chosen = pa.array(list(best)[:out], pa.int64())
        n = len(chosen)
        return pa.Table.from_arrays(
            [query.combine_chunks().take(pa.array([0] * n, pa.int64())), keys.take(chosen), places.take(chosen).cast(pa.int64()), pa.array(list(best.values())[:out], pa.float64()), pa.array(range(1, n + 1), pa.int64()), pa.nulls(n, pa.string())], names=names
        )

    names = ["query_id", "key", "fused_rank", "score", "rank", "error"]
    kinds = {c: pool.schema[c].dataType.simpleString() for c in ("query_id", "key")}
    rows = pool.where(F.col("rank") <= pool_k).select("query_id", "key", "rank", "question", "content")
    return rows.groupBy("query_id").applyInArrow(run, f"query_id {kinds['query_id']}, key {kinds['key']}, fused_rank long, score double, rank long, error string")


def generate(prompt: Column, model: Generate) -> Column:
    """struct<status, text> of each prompt: answered, insufficient_evidence or generation_failed.

    A model that fails on a batch is asked row by row, so that one bad prompt
    costs one row.  A failure never counts as a refusal.
    """

    @F.arrow_udf("struct<status:string,text:string>")
    def run(prompts: pa.Array) -> pa.Array:
        asked = prompts.to_pylist()
        try:
            answers: list[str | None] = list(model(asked))
            if len(answers) != len(asked):
                raise ValueError("the model returned another number of answers")
        except Exception:  # any provider error
            answers = [_alone(model, p) for p in asked]
        return pa.array([_status(a) for a in answers], pa.struct([("status", pa.string()), ("text", pa.string())]))

    return run(prompt)


# Fixed value: the mark that begins a refusal.
REFUSAL = "[INSUFFICIENT]"


def _alone(model: Generate, prompt: str) -> str | None:
    try:
        return model([prompt])[0]
    except Exception:  # this row's own failure
        return None


def _status(answer: str | None) -> dict:
    if answer is None:
        return {"status": "generation_failed", "text": ""}
    if answer.lstrip().startswith(REFUSAL) and len(answer) - len(answer.lstrip()) <= 8:
        return {"status": "insufficient_evidence", "text": ""}
    return {"status": "answered", "text": answer}


def rewrite(question: Column, history_turns: Column, rewritten: Column, limit: int = 2000) -> Column:
    """struct<question, outcome>: skipped without history, unchanged, rewritten, or failed (the question stays)."""
    line = X.first_line(rewritten)
    fine = F.coalesce((line != "") & (F.length(line) <= limit), F.lit(False))
    outcome = F.when(F.coalesce(history_turns, F.lit(0)) == 0, "skipped").when(~fine, "failed").when(line == question, "unchanged").otherwise("rewritten")
    return F.struct(F.when(outcome == "rewritten", line).otherwise(question).alias("question"), outcome.alias("outcome"))


def fallback_mapping(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """rows (evidence_id, candidates array, answer struct or null) as mapped: status, chunk_key, confidence.

    No answer, no key or a key outside the candidates: unmatched; little confidence: low_conf.
    """
    key, sure = F.col("answer.chunk_key"), F.col("answer.confidence")
    inside = F.coalesce(F.array_contains("candidates", key), F.lit(False))
    status = F.when(~inside, "unmatched").when(sure < least, "low_conf").otherwise("matched")
    return rows.select("evidence_id", status.alias("status"), F.when(inside, key).alias("chunk_key"), F.when(inside, sure).otherwise(F.lit(0.0)).alias("confidence"))
