"""Runs over many units that can stop anywhere and go on: mapping, retrieval, answers, judging.

A run is a versioned store.  Its units are dealt into batches by a hash of
their id; each batch is one job and one commit, which adds what the job made
and the ids that it finished.  A run that was stopped goes on with the units
that no commit has, under the same configuration only, and ends with the same
rows as one that wasn't.  A unit whose work fails is a record with an error;
a unit that the work gives no record ends the job, so none is lost silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import markup, records as R, text as X
from ..sources import versions
from ..sources.staging import staged
from . import evaluation, mapping, models, retrieval

#: From the units of a batch to its tables; "records" has a row for each unit.
Work = Callable[[DataFrame], dict[str, DataFrame]]
RUNNING, COMPLETE = "running", "complete"


def run_units(spark: SparkSession, root: str, config: dict, units: DataFrame, work: Work, unit: str = "question_id", batches: int = 4, stop_after: int | None = None) -> versions.Snapshot:
    """Do the work of all units that the run below root hasn't finished; stop_after ends after so many batches.

    config is the run's identity: another one is refused.  Units with a null or
    repeated id are an error.  A run without units is complete at once.
    """
    now = versions.latest(spark, root)
    if now.version and now.note["config"] != config:
        raise ValueError("the folder holds a run with another configuration")
    if not units.where(F.col(unit).isNull()).isEmpty() or not units.groupBy(unit).count().where("count > 1").isEmpty():
        raise ValueError("units need an id each, and only one of each")
    done_batches = set(now.note.get("batches", []))
    made = 0
    for b in range(batches):
        if b in done_batches:
            continue
        if made == stop_after:
            return now
        todo = units.where(F.pmod(F.xxhash64(unit), F.lit(batches)) == b)
        if "done" in now.tables:
            todo = todo.join(now.read(spark, "done"), unit, "left_anti")
        todo = staged(todo, "units")
        tables = dict(work(todo))
        tables["records"] = staged(tables["records"], "records")
        if not todo.join(tables["records"].select(unit), unit, "left_anti").isEmpty():
            raise ValueError("the work left units without a record")
        done_batches.add(b)
        note = {"config": config, "state": RUNNING if len(done_batches) < batches else COMPLETE, "batches": sorted(done_batches)}
        now = versions.commit(spark, root, append={**tables, "done": todo.select(unit)}, base=now, note=note)
        made += 1
    return now


def finish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> versions.Snapshot:
    """Add what is derived from a complete run (summary, failures) as its last version, in place of what was derived before."""
    now = versions.latest(spark, root)
    if now.note.get("state") != COMPLETE:
        raise ValueError("the run isn't complete")
    return versions.commit(spark, root, replace=tables, base=now, note=now.note)


# Retrieval ----------------------------------------------------------------


def retrieval_work(chunks: DataFrame, vectors: DataFrame, evidence: DataFrame, scorer=None, **params: int) -> Work:
    """Work on units question_id, type, level, question, vector, low, high, progress.

    evidence: question_id, key (null: unmapped).  Tables: stages, every row of
    every stage, so that later runs replay them; records, with the keys of each
    stage in order, scores and the error of a query that failed (then all its
    evidence is missed).
    """

    def work(units: DataFrame) -> dict[str, DataFrame]:
        asked = units.select(F.col("question_id").alias("query_id"), "question", "vector")
        realms = units.select(F.col("question_id").alias("query_id"), "low", "high")
        rows = staged(retrieval.retrieve(chunks, vectors, asked, realms, scorer=scorer, errors="rows", **params).withColumnRenamed("query_id", "question_id"), "stages")
        chapter = chunks.select("key", "chapter")
        kept = (F.col("stage") == "assembled") & F.col("reason").isNull()
        ordered = lambda c, by: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(F.col(by).alias("r"), F.col("key").alias("k"))))), lambda x: x["k"])
        stages = [ordered(F.col("stage") == s, "rank").alias(n) for s, n in (("dense", "dense"), ("keyword", "keyword"), ("fused", "fused"), ("reranked", "rerank"))]
        coded = F.concat(F.col("reason"), F.lit(":"), F.col("key").cast("string"))
        by_question = rows.groupBy("question_id").agg(
            *stages, ordered(kept, "place").alias("assembled"), F.array_sort(F.collect_list(F.when((F.col("stage") == "assembled") & F.col("reason").isNotNull(), coded))).alias("dropped"),
            F.max(F.when(F.col("stage") == "failed", F.col("reason"))).alias("error"),
        )
        own = evidence.join(units.select("question_id", "progress"), "question_id")
        found = rows.where(kept).select("question_id", "key").join(chapter, "key")
        scores = evaluation.question_scores(own, found)
        keys = own.groupBy("question_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
        names = ("dense", "keyword", "fused", "rerank", "assembled")
        none = F.array().cast(by_question.schema["dense"].dataType)
        out = units.select("question_id", "type", "level").join(by_question, "question_id", "left").join(scores, "question_id", "left").join(keys, "question_id", "left")
        count = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hit", "mapped", "total", "leak")]
        records = out.select("question_id", "type", "level", *count, F.coalesce("keys", none).alias("keys"), *[F.coalesce(n, none).alias(n) for n in names], F.coalesce("dropped", F.array().cast("array<string>")).alias("dropped"), "error")
        return {"records": records, "stages": rows}

    return work


def retrieval_summary(records: DataFrame) -> dict[str, DataFrame]:
    """summary (all and by type) and failures of a retrieval run's records."""
    every = evaluation.totals(records).withColumn("type", F.lit(None).cast("string"))
    return {"summary": every.unionByName(evaluation.totals(records, "type")), "failures": evaluation.failures(records)}


# Answers and verdicts -----------------------------------------------------


def answer_work(model: models.Generate) -> Work:
    """Work on units question_id, question, passages (array of chapter, content, in order), expect_refusal: records of each answer."""

    def work(units: DataFrame) -> dict[str, DataFrame]:
        shown = F.array_join(F.transform("passages", lambda p: markup.passage_block(p["chapter"], p["content"])), "\n\n")
        answers = staged(units.withColumn("a", models.generate(F.concat(shown, F.lit("\n\n"), F.col("question")), model)).select("question_id", "passages", "expect_refusal", "a.*"), "answers")
        cited = X.citations(F.col("text"))
        chapters = F.transform("passages", lambda p: p["chapter"].cast("int"))
        outside = F.filter(F.array_distinct(cited), lambda c: ~F.array_contains(chapters, c))
        made = answers.withColumn("cited", cited).withColumn("outside", outside)
        answered = F.col("status") == "answered"
        return {"records": made.select(
            "question_id", "status", "text", "expect_refusal", F.size("cited").alias("citation_count"), (answered & (F.size("cited") > 0) & (F.size("outside") == 0)).alias("citation_in_set"),
            F.transform("outside", lambda c: F.concat(F.lit("[C"), c.cast("string"), F.lit("]"))).alias("citation_out_of_range"), F.size(X.violations(F.col("text"))).alias("citation_malformed_count"),
        )}

    return work


def judge_work(model: models.Generate) -> Work:
    """Work on units question_id, question, answer, reference: a strict verdict of each, or none and the reason why."""

    def work(units: DataFrame) -> dict[str, DataFrame]:
        prompt = F.concat_ws("\n\n", "question", "answer", "reference")
        said = staged(units.withColumn("a", models.generate(prompt, model)).select("question_id", "a.*"), "verdicts")
        v = R.verdict(F.col("text"))
        error = F.when(F.col("status") != "answered", F.lit("no answer")).when(v.isNull(), "the verdict isn't one")
        return {"records": said.select("question_id", v.alias("v"), error.alias("error")).select("question_id", "v.*", "error")}

    return work


def mapping_work(docs: DataFrame, spanned: DataFrame) -> Work:
    """Work on units evidence_id, type, doc_id, content: a mapping record and what a reviewer sees of each."""

    def work(units: DataFrame) -> dict[str, DataFrame]:
        evidence = units.select("evidence_id", "doc_id", "content")
        mapped = staged(mapping.locate(evidence, docs, spanned), "mapped")
        return {"records": units.select("evidence_id", "type").join(mapped, "evidence_id"), "review": mapping.review(mapped, evidence, docs, spanned)}

    return work
