"""Scores of retrieval and answers: ratios with explicit denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import ratio


def totals(records: DataFrame, *by: str) -> DataFrame:
    """Ratios of sums over records (hit, mapped, total, leak), for all or by groups."""
    out = records.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.sum("hit").alias("hits"), F.sum("mapped").alias("mapped"), F.sum("total").alias("total"), F.sum("leak").alias("leaks"))
    return out.withColumn("recall", ratio(F.col("hits"), F.col("total"))).withColumn("coverage", ratio(F.col("mapped"), F.col("total")))


def loss_stage(key: Column, assembled: Column, rerank: Column, fused: Column, channels: Column) -> Column:
    """Where an evidence got lost: the last stage that still had it."""
    return F.when(key.isNull(), "unmapped").when(F.array_contains(assembled, key), "assembled").when(F.array_contains(rerank, key), "rerank").when(F.array_contains(fused, key), "fused").when(F.array_contains(channels, key), "fused_truncated").otherwise("channel_missed")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the one with the greatest order: an aggregate, so partial ones come first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, old, new where they differ, missing ones included."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    return a.join(b, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))


def leaks(chapter: Column, progress: Column) -> Column:
    """How many hits lie beyond the reader's progress."""
    return F.count_if(F.coalesce(chapter > progress, F.lit(False)))


def retrieval_stage(record: dict[str, Column]) -> Column:
    """Where a question failed (hit, mapped, total, leak): leak, mapping, retrieval; null where it passed."""
    return F.when(record["leak"] > 0, "leak").when(record["mapped"] < record["total"], "mapping").when(record["hit"] < record["total"], "retrieval")


def answer_totals(records: DataFrame, *by: str) -> DataFrame:
    """Counts over generation records (status, citation_count, citation_in_set, citation_out_of_range, citation_malformed_count, expect_refusal).

    Citations count over answered rows only; expected refusals keep their failures in the denominator.
    """
    c, answered = F.col, F.col("status") == "answered"
    refused = c("status") == "insufficient_evidence"
    out = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(answered).alias("answered"), F.count_if(c("status") == "generation_failed").alias("failed"),
        F.count_if(answered & c("citation_in_set")).alias("in_set"), F.count_if(answered & (c("citation_count") == 0)).alias("uncited"),
        F.sum(F.size("citation_out_of_range")).alias("out_of_range"), F.sum("citation_malformed_count").alias("malformed"),
        F.count_if(c("expect_refusal")).alias("refusals_expected"), F.count_if(c("expect_refusal") & refused).alias("refusals_given"), F.count_if(~c("expect_refusal") & refused).alias("false_refusals"),
    )
    return out.withColumn("in_set_ratio", ratio(c("in_set"), c("answered"))).withColumn("refusal_ratio", ratio(c("refusals_given"), c("refusals_expected")))


def answer_stage(record: dict[str, Column]) -> Column:
    """Where an answer failed: generation, citation, refusal; null where it passed."""
    return F.when(record["status"] == "generation_failed", "generation").when(F.size(record["citation_out_of_range"]) > 0, "citation").when(record["expect_refusal"] & (record["status"] != "insufficient_evidence"), "refusal")


def judge_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Verdicts over judged rows, failed ones apart, and how often each flag is false."""
    flags = ["supported", "citations_valid", "complete", "refusal_correct"]
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "fail", "uncertain")]
    return rows.groupBy(*by).agg(F.count("verdict").alias("judged"), F.count_if(F.col("verdict").isNull()).alias("failed"), *counts, *[F.count_if(~F.col(f)).alias(f"not_{f}") for f in flags])


def mapping_summary(rows: DataFrame) -> DataFrame:
    """dimension, value, n over mapping records (status, tier, type), and the share that is matched as coverage rows."""
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("status", F.col("status")), ("tier", F.col("tier")), ("type:status", F.concat_ws(":", "type", "status")))]))
    counted = rows.select(sides.alias("s")).select("s.*").where("value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    share = rows.agg(ratio(F.count_if(F.col("status") == "matched"), F.count(F.lit(1))).alias("n")).select(F.lit("coverage").alias("dimension"), F.lit("matched").alias("value"), "n")
    return counted.unionByName(share)


def stale_mappings(mappings: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mappings (evidence_hash, chunk_key) that no longer hold: evidence gone, chunk gone, or its text without the content."""
    e, c = evidence.select("evidence_hash", F.col("content").alias("__needle")), chunks.select("chunk_key", F.col("content").alias("__chunk"))
    joined = mappings.join(e, "evidence_hash", "left").join(c, "chunk_key", "left")
    reason = F.when(F.col("__needle").isNull(), "evidence").when(F.col("__chunk").isNull(), "chunk").when(~F.contains("__chunk", "__needle"), "content")
    return joined.select("evidence_hash", "chunk_key", reason.alias("reason")).where("reason is not null")


def markdown_table(rows: DataFrame, *columns: str) -> DataFrame:
    """One Markdown line a row, in order of place; a bar inside a value is escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("?")), r"\|", r"\\|") for c in columns]
    return rows.select("place", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def stage_sets(record: dict[str, Column]) -> dict[str, Column]:
    """Distinct keys of each stage of a retrieval record; channels are the dense and the keyword one together."""
    own = {s: F.array_distinct(F.coalesce(record[s], F.array().cast("array<long>"))) for s in ("dense", "keyword", "fused", "rerank", "assembled")}
    return {"channels": F.array_union(own["dense"], own["keyword"]), **{s: own[s] for s in ("fused", "rerank", "assembled")}}


def attribution(evidence: DataFrame, records: DataFrame, recorded: bool = False) -> DataFrame:
    """evidence (question_id, type, key; null: unmapped) with the stage in which it got lost.

    records: question_id with dense, keyword, fused, rerank, assembled (arrays
    of keys).  A question without record ends the job; with recorded, so does
    one whose records' hit differs from the evidence found assembled.
    """
    sets = stage_sets({s: F.col(s) for s in ("dense", "keyword", "fused", "rerank", "assembled")})
    known = records.select("question_id", *[v.alias(k) for k, v in sets.items()], *(["hit"] if recorded else []), F.lit(True).alias("there"))
    both = evidence.join(known, "question_id", "left")
    stage = loss_stage(F.col("key"), F.col("assembled"), F.col("rerank"), F.col("fused"), F.col("channels"))
    checked = F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("no record of question "), F.col("question_id").cast("string"))).cast("string")).otherwise(stage)
    out = both.withColumn("stage", checked)
    if recorded:
        found = F.count_if(F.col("stage") == "assembled").over(Window.partitionBy("question_id"))
        out = out.withColumn("stage", F.when(found == F.col("hit"), F.col("stage")).otherwise(F.raise_error(F.concat(F.lit("hits don't reconcile for question "), F.col("question_id").cast("string"))).cast("string")))
    return out.select("question_id", "type", "key", "stage")


def loss_table(attributed: DataFrame) -> DataFrame:
    """type, stage, rows, distinct_keys over attributed evidence; type null: all types."""
    return attributed.groupingSets([["stage"], ["type", "stage"]], "type", "stage").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("distinct_keys"))


def failures(records: DataFrame) -> DataFrame:
    """Failed questions (question_id, hit, mapped, total, leak, keys, rerank, assembled) with their stage and the keys that weren't assembled."""
    lost = F.array_sort(F.array_except("keys", "assembled"))
    before = F.exists("keys", lambda k: ~F.array_contains(F.col("rerank"), k))
    stage = F.when(F.col("leak") > 0, "leak").when(F.col("mapped") < F.col("total"), "mapping").when(before, "retrieval").otherwise("assembly")
    return records.where((F.col("hit") < F.col("total")) | (F.col("leak") > 0)).select("question_id", stage.alias("stage"), lost.alias("lost"))


def question_scores(evidence: DataFrame, assembled: DataFrame) -> DataFrame:
    """question_id, hit, mapped, total, leak from evidence (question_id, key, progress) and what was assembled (question_id, key, chapter)."""
    keys = assembled.select("question_id", "key").distinct().withColumn("found", F.lit(True))
    per = evidence.join(keys, ["question_id", "key"], "left").groupBy("question_id").agg(F.count_if("found").alias("hit"), F.count("key").alias("mapped"), F.count(F.lit(1)).alias("total"), F.max("progress").alias("progress"))
    seen = assembled.join(per.select("question_id", "progress"), "question_id").groupBy("question_id").agg(leaks(F.col("chapter"), F.col("progress")).alias("leak"))
    return per.join(seen, "question_id", "left").select("question_id", "hit", "mapped", "total", F.coalesce("leak", F.lit(0)).cast("long").alias("leak"))


def drop_samples(dropped: DataFrame) -> DataFrame:
    """reason, n, first_query over what assembly left out (query_id, reason)."""
    return dropped.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("query_id").alias("first_query"))


def quota_errors(questions: DataFrame, total: int = 60, per_type: int = 8, refusals: int = 10) -> DataFrame:
    """rule, value: quotas that a dataset (id, type, expect_refusal, file) misses, and ids in several files."""
    types = questions.groupBy("type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < per_type).select(F.concat(F.lit("type:"), "type").alias("rule"), F.col("n").alias("value"))
    every = questions.agg(F.count(F.lit(1)).alias("n"), F.count_if("expect_refusal").alias("r"))
    few = every.select(F.explode(F.array(F.struct(F.lit("total").alias("rule"), F.col("n").alias("value"), F.lit(total).alias("least")), F.struct(F.lit("refusals").alias("rule"), F.col("r").alias("value"), F.lit(refusals).alias("least")))).alias("q")).select("q.*").where("value < least").drop("least")
    twice = questions.groupBy("id").agg(F.countDistinct("file").alias("n")).where("n > 1").select(F.concat(F.lit("duplicate:"), F.col("id").cast("string")).alias("rule"), F.col("n").alias("value"))
    return few.unionByName(types).unionByName(twice)


def cross_field_errors(question: dict[str, Column], chapters: int) -> Column:
    """Sorted messages on fields that don't agree: level, progress, the chapters of evidence, refusals with citations."""
    p, cited = question["progress"], question["chapters"]
    rules = [
        ((question["level"] == "past") & p.isNull(), "past needs progress"),
        ((question["level"] == "full") & p.isNotNull(), "full has no progress"),
        (F.exists(cited, lambda c: ~c.between(1, chapters)), "chapter is out of range"),
        ((question["level"] == "past") & F.exists(cited, lambda c: c > p), "evidence lies beyond progress"),
        (question["expect_refusal"] & (F.size(cited) > 0), "a refusal cites nothing"),
        (~question["expect_refusal"] & (F.size(cited) == 0), "an answer needs evidence"),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules])))


def prefix_breaks(full: DataFrame, past: DataFrame, inside: DataFrame) -> DataFrame:
    """query_id, breaks: places where the full ranking (query_id, key, score, rank), cut to inside (key), isn't the past ranking."""
    order = Window.partitionBy("query_id").orderBy("rank")
    cut = full.join(inside.select("key"), "key", "left_semi").select("query_id", F.row_number().over(order).alias("place"), F.col("key").alias("a"), F.col("score").alias("x"))
    other = past.select("query_id", F.col("rank").alias("place"), F.col("key").alias("b"), F.col("score").alias("y"))
    # the full ranking may end earlier, as what lies outside took places
    both = cut.join(other, ["query_id", "place"], "left")
    return both.groupBy("query_id").agg(F.count_if(~F.coalesce((F.col("a") == F.col("b")) & (F.col("x") == F.col("y")), F.lit(False))).alias("breaks"))


def subset(questions: DataFrame, asked: DataFrame) -> DataFrame:
    """The questions (id) that asked (id) names, once each; a name that no question has ends the job."""
    known = questions.select("id", F.lit(True).alias("__there"))
    named = asked.select("id").distinct().join(known, "id", "left")
    kind = questions.schema["id"].dataType
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no question "), F.col("id").cast("string"))).cast(kind)).otherwise(F.col("id"))
    return questions.join(named.select(checked.alias("id")).distinct(), "id")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """side and the rows that only one of two tables has, as often as it has them more."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """place and the columns of two tables side by side, in order; tables of different lengths end the job."""
    from ..sources.corpus import placed

    x, y = placed(a, order_a), placed(b, order_b, "__place")
    both = x.join(y, F.col("place") == F.col("__place"), "full")
    gap = F.col("place").isNull() | F.col("__place").isNull()
    return both.withColumn("place", F.when(gap, F.raise_error(F.lit("the tables differ in length")).cast("long")).otherwise(F.col("place"))).drop("__place")


def replay(requests: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """requests with their recorded outcome, found by all keys (null equals null); a request without one ends the job."""
    known = recorded.select(*[F.col(k).alias(f"__{k}") for k in keys], "outcome", F.lit(True).alias("__there"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = requests.join(known, same, "left")
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.lit("no recorded outcome of a request")).cast(recorded.schema["outcome"].dataType)).otherwise(F.col("outcome"))
    return out.withColumn("outcome", checked).drop("__there", *[f"__{k}" for k in keys])
