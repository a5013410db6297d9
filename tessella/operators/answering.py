"""Answers to questions as ordered event streams, from a retrieval's stages to the end of each stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import markup
from ..sources.staging import staged
from . import models

# How an answer ends, and what is said where the evidence is too thin.
ANSWERED, INSUFFICIENT = "answered", "insufficient_evidence"
REFUSED = "The passages that may be read don't answer this question."
#: How many keys of a ranking an event names.
TOP = 5


def contexts(stages: DataFrame, chunks: DataFrame) -> DataFrame:
    """request_id, passages (array of place, key, chapter, source, content, tokens, in order): what assembly kept for each request."""
    kept = stages.where("stage = 'assembled' and reason is null").select(F.col("query_id").alias("request_id"), "key", "place", "source")
    rows = kept.join(chunks.select("key", "chapter", "content", "tokens"), "key")
    return rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "key", "chapter", "source", "content", "tokens"))).alias("passages"))


def facts(stages: DataFrame) -> DataFrame:
    """request_id and what the events tell of each stage: counts, first keys, what was dropped, why it failed."""
    of = lambda s: F.col("stage") == s
    ranked = lambda s, *c: F.slice(F.array_sort(F.collect_list(F.when(of(s) & (F.col("rank") <= TOP), F.struct("rank", F.col("key").cast("string").alias("chunk_key"), *c)))), 1, TOP)
    dropped = F.array_sort(F.collect_list(F.when(of("assembled") & F.col("reason").isNotNull(), F.struct("rank", F.col("key").cast("string").alias("chunk_key"), "reason"))))
    return stages.groupBy(F.col("query_id").alias("request_id")).agg(
        *[F.count_if(of(s)).alias(n) for s, n in (("dense", "dense_count"), ("keyword", "bm25_count"), ("fused", "fused_count"), ("reranked", "output_count"))],
        ranked("fused").alias("fused_top"), ranked("reranked", "score").alias("ranked"), dropped.alias("dropped"), F.max(F.when(of("failed"), F.col("reason"))).alias("failure"),
    )


def prompts(question: Column, passages: Column) -> Column:
    """The passages in their order, each below its chapter, and the question."""
    return F.concat(F.array_join(F.transform(passages, lambda p: markup.passage_block(p["chapter"], p["content"])), "\n\n"), F.lit("\n\n"), question)


def answer_events(requests: DataFrame, stages: DataFrame, chunks: DataFrame, model: models.Generate, model_name: str = "stand-in", prompt_version: str = "1", rerank_k: int = 32, delta_chars: int = 200, refused: str = REFUSED) -> DataFrame:
    """request_id, seq, name, payload (JSON) of every request's stream, in the order that ``flows.order_errors`` checks.

    requests: request_id, level, progress, low, high, question, rewrite
    (struct<question, outcome> of ``models.rewrite``, or null).  stages and
    chunks are those of ``retrieval.retrieve``, asked with the rewritten
    questions.  A rewrite that was skipped has no event.  Without context, and
    where the model's answer begins with the mark of a refusal, the answer is
    the fixed text and the stream ends as insufficient evidence.  A retrieval or
    a model that fails ends the stream with an error, and never as a refusal.
    """
    rewrite = F.coalesce(F.col("rewrite.outcome"), F.lit("skipped"))
    asked = requests.withColumn("effective", F.coalesce("rewrite.question", "question")).withColumn("outcome", rewrite)
    held = staged(asked.join(facts(stages), "request_id", "left").join(contexts(stages, chunks), "request_id", "left"), "asked")
    found = F.col("passages").isNotNull()
    # only what has a context is put to the model
    said = held.where(found & F.col("failure").isNull()).select("request_id", models.generate(prompts(F.col("effective"), F.col("passages")), model).alias("a"))
    both = held.join(staged(said, "answers"), "request_id", "left")
    status = F.when(F.col("failure").isNotNull() | (F.col("a.status") == "generation_failed"), F.lit("error")).when(~found | (F.col("a.status") == INSUFFICIENT), INSUFFICIENT).otherwise(ANSWERED)
    rows = both.withColumn("status", status)
    id_ = F.col("request_id").cast("string").alias("request_id")
    plain = lambda a, *names: F.transform(a, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    chapters = F.array_sort(F.array_distinct(F.transform(F.coalesce("passages", F.array().cast(contexts(stages, chunks).schema["passages"].dataType)), lambda p: p["chapter"])))
    tokens = F.coalesce(F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]), F.lit(0))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    event = lambda name, *fields: F.struct(F.lit(name).alias("name"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))
    error = event("query_error", id_, F.when(F.col("failure").isNotNull(), "RETRIEVAL_FAILED").otherwise("GENERATION_FAILED").alias("code"), F.coalesce("failure", F.lit("the model failed")).alias("message"))
    head = [event("query_started", id_, "level", "progress")]
    searched = [
        event("realm_resolved", F.col("low").alias("lo"), F.col("high").alias("hi")),
        F.when(F.col("outcome") != "skipped", event("rewrite_completed", F.col("outcome").alias("status"), F.col("question").alias("original"), "effective")),
        event("retrieval_completed", count("dense_count"), count("bm25_count"), count("fused_count"), plain("fused_top", "chunk_key").alias("fused_top")),
        event("rerank_completed", F.least(F.coalesce("fused_count", F.lit(0)), F.lit(rerank_k)).alias("input_count"), count("output_count"), plain("ranked", "chunk_key", "score").alias("ranked")),
        event("context_assembled", plain("passages", "key", "chapter", "source").alias("chunks"), tokens.alias("token_estimate"), plain("dropped", "chunk_key", "reason").alias("dropped")),
        event("generation_started", F.lit(model_name).alias("answer_model"), F.lit(prompt_version).alias("prompt_version")),
    ]
    pieces = F.regexp_extract_all(F.col("a.text"), F.lit(rf"(?s).{{1,{delta_chars}}}"), F.lit(0))
    delta = lambda text: F.struct(F.lit("answer_delta").alias("name"), F.to_json(F.struct(text.alias("text"))).alias("payload"))
    deltas = F.when(F.col("status") == ANSWERED, F.transform(pieces, delta)).otherwise(F.array(delta(F.lit(refused))))
    end = [event("citation_ready", chapters.alias("context_chapters")), event("query_done", F.col("status"), chapters.alias("context_chapters"), F.struct(tokens.alias("context_tokens")).alias("usage"))]
    retrieved = F.array_compact(F.array(*head, *searched))
    events = F.when(F.col("failure").isNotNull(), F.array(*head, error)).when(F.col("status") == "error", F.concat(retrieved, F.array(error))).otherwise(F.concat(retrieved, deltas, F.array(*end)))
    return rows.select("request_id", F.posexplode(events).alias("seq", "e")).select("request_id", F.col("seq").cast("long").alias("seq"), "e.name", "e.payload")
