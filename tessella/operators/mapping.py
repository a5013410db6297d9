"""Evidence to chunks: spans of chunks, occurrences of evidence, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import find_all
from .intervals import overlapping

# Statuses and tiers.
MATCHED, LOW, UNMATCHED = "matched", "low_conf", "unmatched"
UNIQUE, INTRODUCER, MAX_COVERAGE = "unique_cover", "introducer", "max_coverage"


def spans(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, length, overlap) with start and end in the document."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("length") - F.col("overlap")).over(order)
    return chunks.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col("length")).cast("int"))


def frozen_slices(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, content, overlap) with length, start and end, held against the texts that they were cut from.

    A chunk of a document that isn't there, one whose content isn't what stands
    in its span, one whose overlap isn't the end of the chunk before, and a
    document whose chunks end before its text does end the job.
    """
    sized = spans(chunks.withColumn("length", F.length("content")))
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    texts = docs.select("doc_id", "text", F.lit(True).alias("there"))
    rows = sized.withColumn("before", F.lag("content").over(order)).withColumn("last", F.lead("chunk_index").over(order).isNull()).join(texts, "doc_id", "left")
    at = F.format_string("chunk %d of document %s", F.col("chunk_index"), F.col("doc_id").cast("string"))
    repeated = F.coalesce(F.endswith("before", F.left("content", F.col("overlap"))), F.col("overlap") == 0)
    problem = (
        F.when(F.col("there").isNull(), "its document isn't there").when(F.substr("text", F.col("start") + 1, F.col("length")) != F.col("content"), "it isn't what stands in its span")
        .when(~repeated, "its overlap isn't the end of the chunk before").when(F.col("last") & (F.col("end") < F.length("text")), "the text goes on after the last chunk")
    )
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(at, F.lit(": "), problem)).cast("int")).otherwise(F.col("end"))
    return rows.withColumn("end", checked).select(*[c for c in chunks.columns], "length", "start", "end")


def occurrences(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """evidence_id, doc_id, start, end of every place of an evidence (evidence_id, doc_id, content) in its document."""
    found = evidence.join(docs.select("doc_id", "text"), "doc_id")
    at = found.select("evidence_id", "doc_id", "content", F.explode(find_all(F.col("text"), F.col("content"))).alias("start"))
    return at.select("evidence_id", "doc_id", "start", (F.col("start") + F.length("content")).cast("int").alias("end"))


#: Positions of a bin in which spans and occurrences meet: a few chunks long.
BIN = 2048


def near_spans(at: DataFrame, spanned: DataFrame) -> DataFrame:
    """Occurrences (evidence_id, doc_id, start, end) with each span (s, e, overlap, chunk_index) that they overlap, covers and introduces."""
    s = spanned.select("doc_id", "chunk_index", F.col("start").alias("other_start"), F.col("end").alias("other_end"), "overlap")
    near = overlapping(at, s, ["doc_id"], BIN).withColumnsRenamed({"other_start": "s", "other_end": "e"})
    covers = (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e"))
    return near.withColumn("covers", covers).withColumn("introduces", F.col("covers") & (F.col("end") - F.col("s") > F.col("overlap")))


def coverages(evidence: DataFrame, docs: DataFrame, spanned: DataFrame) -> DataFrame:
    """evidence_id, doc_id, chunk_index, s, e, overlap, offsets, in_new_content: every chunk that holds a place of an evidence.

    offsets are the places inside the chunk, in order; in_new_content tells
    whether one of them reaches beyond what the chunk repeats.
    """
    inside = near_spans(occurrences(evidence, docs), spanned).where("covers")
    got = inside.groupBy("evidence_id", "doc_id", "chunk_index", "s", "e", "overlap").agg(F.array_sort(F.collect_list(F.col("start") - F.col("s"))).alias("offsets"), F.max("introduces").alias("in_new_content"))
    return got


def locate(evidence: DataFrame, docs: DataFrame, spanned: DataFrame) -> DataFrame:
    """evidence_id, status, chunk_index, tier, confidence, alternative, reason of each evidence.

    A chunk covers an occurrence if its span holds it; one that has it beyond
    its overlap introduces it.  One covering chunk: it; one introducer: it;
    else the lowest index.  Without cover: the chunk with the largest overlap,
    low confidence.  alternative: the lowest other covering chunk.  A document
    that isn't there ends the job.
    """
    known = docs.select("doc_id", F.lit(True).alias("there"))
    id_ = F.col("evidence_id").cast("string")
    there = F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("no document for evidence "), id_)).cast("string")).otherwise(id_)
    asked = evidence.join(known, "doc_id", "left").withColumn("evidence_id", there.cast(evidence.schema["evidence_id"].dataType)).select("evidence_id", "doc_id", "content")
    near = near_spans(occurrences(evidence, docs), spanned)
    common = F.least("end", "e") - F.greatest("start", "s")
    per = near.withColumn("common", common).groupBy("evidence_id", "chunk_index").agg(F.max("covers").alias("covers"), F.max("introduces").alias("introduces"), F.max("common").alias("common"))
    got = per.groupBy("evidence_id").agg(
        F.count_if("covers").alias("n"), F.count_if("introduces").alias("m"),
        F.min(F.when(F.col("covers"), F.col("chunk_index"))).alias("lowest"), F.min(F.when(F.col("introduces"), F.col("chunk_index"))).alias("introducer"),
        F.max(F.struct("common", (-F.col("chunk_index")).alias("i"))).alias("partial"),
        F.array_sort(F.collect_list(F.when(F.col("covers"), F.col("chunk_index")))).alias("covering"),
    )
    out = asked.select("evidence_id").join(got, "evidence_id", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n > 0, MATCHED).when(F.col("partial").isNotNull(), LOW).otherwise(UNMATCHED)
    tier = F.when(n == 1, UNIQUE).when((n > 1) & (F.col("m") == 1), INTRODUCER).when(n > 1, MAX_COVERAGE)
    index = F.when(n == 1, F.col("lowest")).when((n > 1) & (F.col("m") == 1), F.col("introducer")).when(n > 1, F.col("lowest")).otherwise(-F.col("partial.i"))
    made = out.select("evidence_id", status.alias("status"), index.cast("int").alias("chunk_index"), tier.alias("tier"), F.when(status == MATCHED, 1.0).otherwise(0.0).alias("confidence"), "covering", n.alias("n"))
    other = F.when(F.col("n") > 1, F.try_element_at(F.filter("covering", lambda c: c != F.col("chunk_index")), F.lit(1)))
    why = (
        F.when(F.col("tier") == UNIQUE, "one chunk covers it").when(F.col("tier") == INTRODUCER, F.format_string("%d chunks cover it, one introduces it", "n"))
        .when(F.col("tier") == MAX_COVERAGE, F.format_string("%d chunks cover it, the first is taken", "n")).when(F.col("status") == LOW, "no chunk covers it, the largest overlap is taken").otherwise("it stands nowhere")
    )
    return made.select("evidence_id", "status", "chunk_index", "tier", "confidence", other.alias("alternative"), why.alias("reason"))


#: Characters of context around a chunk and around a place inside it that a reviewer sees.
AROUND, INSIDE = 80, 160


def review(mapped: DataFrame, evidence: DataFrame, docs: DataFrame, spanned: DataFrame) -> DataFrame:
    """What a reviewer sees of each mapped evidence.

    evidence_id, doc_id, content, status, tier, chunk_index, alternative,
    reason, offsets (all places in the document), coverages (array of
    chunk_index, start, end, overlap, offsets, in_new_content), before, inside,
    after (texts around the chosen chunk and the first place in it), cut_head,
    cut_tail.  Without a place: empty arrays and texts.
    """
    places = occurrences(evidence, docs).groupBy("evidence_id").agg(F.array_sort(F.collect_list("start")).alias("offsets"))
    view = F.struct("chunk_index", F.col("s").alias("start"), F.col("e").alias("end"), "overlap", "offsets", "in_new_content")
    covers = coverages(evidence, docs, spanned).groupBy("evidence_id").agg(F.array_sort(F.collect_list(view)).alias("coverages"))
    rows = evidence.join(mapped, "evidence_id").join(places, "evidence_id", "left").join(covers, "evidence_id", "left").join(docs.select("doc_id", "text"), "doc_id", "left")
    chosen = rows.withColumn("c", F.try_element_at(F.filter("coverages", lambda v: v["chunk_index"] == F.col("chunk_index")), F.lit(1)))
    low, high = F.col("c.start"), F.col("c.end")
    at = low + F.element_at(F.col("c.offsets"), 1)
    begin, stop = F.greatest(low, at - INSIDE), F.least(high, at + F.length("content") + INSIDE)
    piece = lambda a, b: F.coalesce(F.substr("text", (a + 1).cast("int"), (b - a).cast("int")), F.lit(""))
    return chosen.select(
        "evidence_id", "doc_id", "content", "status", "tier", "chunk_index", "alternative", "reason", F.coalesce("offsets", F.array().cast("array<int>")).alias("offsets"),
        F.coalesce("coverages", F.array().cast(covers.schema["coverages"].dataType)).alias("coverages"),
        piece(F.greatest(low - AROUND, F.lit(0)), low).alias("before"), piece(begin, stop).alias("inside"), piece(high, high + AROUND).alias("after"),
        F.coalesce(begin > low, F.lit(False)).alias("cut_head"), F.coalesce(stop < high, F.lit(False)).alias("cut_tail"),
    )
