import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import intervals, mapping, models, quota, retrieval, vector_index
from tessella.plans import registry
from tessella.streaming import summaries

SF = "/root/testdata/sf0.1"


# Vector index -------------------------------------------------------------


def test_index_recall_is_reached(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vector_index.build(spark, str(tmp_path / "index"), vectors, "vec_id")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    probes = vector_index.tune(spark, index, vectors, asked.where("query_id % 50 = 7"), "vec_id", k=20, least=0.92)
    queries = asked.where("query_id % 50 = 0")
    exact = retrieval.nearest(vectors, queries, "vec_id", k=20)
    found = vector_index.search(spark, index, queries, 20, probes)
    assert vector_index.recall(found, exact) >= 0.9 and probes < index.note["cells"]
    # what is found has the exact score
    scores = {(r.query_id, r["key"]): r.score for r in exact.collect()}
    assert all(r.score == scores[r.query_id, r["key"]] for r in found.collect() if (r.query_id, r["key"]) in scores)
    # every vector is in one list, and a search opens only the probed ones
    lists = index.read(spark, "lists")
    assert lists.count() == vectors.count() == lists.select("key").distinct().count()
    plan = vector_index.search(spark, index, queries.limit(1), 20, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_index_finds_clusters_with_few_probes(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    x = np.repeat(middles, 50, axis=0) + 0.1 * rng.normal(size=(600, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, embedding array<double>")
    index = vector_index.build(spark, str(tmp_path / "index"), vectors, "key", cells=12)
    queries = vectors.where("key % 25 = 0").select(F.col("key").alias("query_id"), F.col("embedding").alias("vector"))
    exact = retrieval.nearest(vectors, queries, "key", k=10)
    assert vector_index.recall(vector_index.search(spark, index, queries, 10, 2), exact) >= 0.95


def test_index_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_key long, embedding array<double>")
    index = vector_index.build(spark, str(tmp_path / "index"), vectors)
    queries = spark.createDataFrame([(7, [2.0, 0.1]), (8, None)], "query_id long, vector array<double>")
    got = vector_index.search(spark, index, queries, 3, probes=99).orderBy("rank").collect()
    assert [r["key"] for r in got][0] in (1, 5) and {r["key"] for r in got} <= {1, 2, 5} and len(got) == 3
    realms = spark.createDataFrame([(7, 2, 2)], "query_id long, low long, high long")
    placed = vector_index.build(spark, str(tmp_path / "placed"), vectors, place="chunk_key")
    assert [r["key"] for r in vector_index.search(spark, placed, queries, 3, 99, realms).collect()] == [2]
    with pytest.raises(ValueError, match="differ"):
        vector_index.search(spark, index, spark.createDataFrame([(7, [1.0])], "query_id long, vector array<double>"), 3)
    with pytest.raises(Exception, match="differ"):
        vector_index.build(spark, str(tmp_path / "bad"), spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_key long, embedding array<double>"))
    none = vector_index.build(spark, str(tmp_path / "none"), vectors.limit(0))
    assert vector_index.search(spark, none, queries, 3).count() == 0
    assert vector_index.search(spark, index, queries.limit(0), 3).count() == 0


def test_search_index_query(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["vector_index_search"](spark, sf)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert vector_index.recall(got, retrieval.nearest(vectors, queries, "vec_id")) >= 0.9


def test_too_many_queries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_NUMBERS", 5)
    monkeypatch.setattr(retrieval, "MAX_TOKENS", 2)
    queries = spark.createDataFrame([(i, "a b c", [1.0, 2.0]) for i in range(3)], "query_id long, question string, vector array<double>")
    with pytest.raises(ValueError, match="several calls"):
        retrieval.question_rows(queries)
    with pytest.raises(ValueError, match="several calls"):
        retrieval.bm25(spark.createDataFrame([(1, "a")], "key long, content string"), queries, "key", "content")


# Reranking and assembly ---------------------------------------------------


def pool_of(spark, rows):
    return spark.createDataFrame(rows, "query_id long, key string, rank int, question string, content string")


def test_group_scorer_sees_whole_pools_in_order(spark):
    pool = pool_of(spark, [(1, "c", 3, "q", "text c"), (1, "a", 1, "q", "text a"), (1, "b", 2, "q", "text b"), (1, "late", 9, "q", "no"), (2, "z", 1, "p", "only")])

    def model(question, texts):
        assert texts == (["text a", "text b", "text c"] if question == "q" else ["only"])
        return [(i, float(i % 2)) for i in reversed(range(len(texts)))] + [(0, 0.0)]

    got = sorted(tuple(r) for r in models.rerank_groups(pool, model, pool_k=3, out=2).collect())
    assert got == [(1, "a", 1, 0.0, 2, None), (1, "b", 2, 1.0, 1, None), (2, "z", 1, 0.0, 1, None)]


def test_faulty_scorers(spark):
    pool = pool_of(spark, [(1, "a", 1, "good", "x"), (2, "b", 1, "outside", "x"), (3, "c", 1, "nan", "x"), (4, "d", 1, "down", "x")])

    def model(question, texts):
        if question == "down":
            raise RuntimeError("no answer")
        return {"good": [(0, 1.0)], "outside": [(1, 1.0)], "nan": [(0, float("nan"))]}[question]

    got = {r.query_id: (r["key"], r.error) for r in models.rerank_groups(pool, model, errors="rows").collect()}
    assert got[1] == ("a", None) and got[4] == (None, "RuntimeError: no answer")
    assert all(got[i][0] is None and "isn't there" in got[i][1] for i in (2, 3))
    with pytest.raises(Exception, match="no answer"):
        models.rerank_groups(pool.where("query_id = 4"), model).collect()
    assert models.rerank_groups(pool.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        models.rerank_groups(pool, model, out=0)


def settle_twin(hits, chunks, realm, chapters, per_chapter, top_k, budget):
    """Assembly step by step: key: reason or place."""
    inside = lambda c: realm[0] <= c <= realm[1]
    why, admitted, items = {}, {}, []
    for h in sorted(hits, key=lambda h: h["rank"]):
        c = h["chapter"]
        if not inside(c):
            why[h["key"]] = "realm"
        elif c not in admitted and len(admitted) >= chapters:
            why[h["key"]] = "chapter_cap"
        elif len(admitted.setdefault(c, [])) >= per_chapter:
            why[h["key"]] = "chapter_chunk_cap"
        else:
            admitted[c].append(h)
    for c, picked in admitted.items():
        items += [(h["rank"], 0, h["key"], c, h["chunk_index"], h["tokens"], h["key"]) for h in picked]
        if len(picked) < per_chapter:
            best = picked[0]
            for d in (-1, 1):
                n = next((x for x in chunks if x["chapter"] == c and x["chunk_index"] == best["chunk_index"] + d), None)
                if n and n["key"] not in {h["key"] for h in picked}:
                    items.append((best["rank"], 1, n["key"], c, n["chunk_index"], n["tokens"], best["key"]))
                    break
    items.sort()
    for x in items[top_k:]:
        why[x[2]] = "top_k_cap"
    items = items[:top_k]
    while sum(x[5] for x in items if not x[1]) > budget:
        worst = max(x[0] for x in items if not x[1])
        gone = next(x[2] for x in items if x[0] == worst and not x[1])
        for x in [x for x in items if x[6] == gone]:
            why[x[2]] = "token_budget"
            items.remove(x)
    while sum(x[5] for x in items) > budget:
        last = max(x for x in items if x[1])
        why[last[2]] = "token_budget"
        items.remove(last)
    return why | {x[2]: i for i, x in enumerate(sorted(items, key=lambda x: (x[3], x[4])), 1)}


def test_assembly_is_its_twin(spark):
    rng = random.Random(8)
    chunks = [{"key": 10 * c + i, "chapter": c, "chunk_index": i, "tokens": rng.randint(5, 60)} for c in range(9) for i in range(6)]
    hits, realms = [], []
    for q in range(60):
        realms.append((q, rng.randint(0, 3), rng.randint(4, 9)))
        for rank, c in enumerate(rng.sample(chunks, rng.randint(0, 16)), 1):
            hits.append({"query_id": q, "rank": rank, **c})
    df = spark.createDataFrame(hits, "query_id long, rank int, key long, chapter int, chunk_index int, tokens int")
    got = retrieval.settled(df, spark.createDataFrame(chunks, "key long, chapter int, chunk_index int, tokens int"), spark.createDataFrame(realms, "query_id long, low int, high int"), True, 3, 2, 5, 150)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r["key"]] = r.reason or r.place
    for q, low, high in realms:
        own = [h for h in hits if h["query_id"] == q]
        assert found.get(q, {}) == settle_twin(own, chunks, (low, high), 3, 2, 5, 150), q
    reasons = {v for f in found.values() for v in f.values() if isinstance(v, str)}
    assert reasons == {"realm", "chapter_cap", "chapter_chunk_cap", "top_k_cap", "token_budget"}
    # a query without realm keeps nothing
    none = retrieval.settled(df.where("query_id < 3"), spark.createDataFrame(chunks), spark.createDataFrame([], "query_id long, low int, high int"))
    assert {r.reason for r in none.collect()} <= {"realm"}


def test_retrieval_takes_a_scorer_and_refuses_empty_questions(spark):
    chunks = spark.createDataFrame([(i, i // 4, i % 4, f"word{i % 5} sea" * 3, 9) for i in range(40)], "key long, chapter long, chunk_index long, content string, tokens int")
    vectors = chunks.select("key", "chapter", F.array((F.col("key") % 7).cast("double"), F.lit(1.0)).alias("embedding"))
    queries = spark.createDataFrame([(1, " word3 \n sea ", [1.0, 1.0])], "query_id long, question string, vector array<double>")
    realms = spark.createDataFrame([(1, 2, 6)], "query_id long, low long, high long")
    seen = lambda question, texts: [(i, -float(i) if question == "word3 sea" else 1e9) for i in range(len(texts))]
    got = retrieval.retrieve(chunks, vectors, queries, realms, scorer=seen).collect()
    by = lambda stage: [r["key"] for r in sorted((r for r in got if r.stage == stage), key=lambda r: r["rank"])]
    assert by("reranked") == by("fused")[:24] and {r["key"] // 4 for r in got} <= set(range(2, 7))
    kept = [r for r in got if r.stage == "assembled" and r.reason is None]
    assert sorted(r.place for r in kept) == list(range(1, len(kept) + 1))
    with pytest.raises(Exception, match="empty question"):
        retrieval.retrieve(chunks, vectors, queries.withColumn("question", F.lit(" \n ")), realms).collect()


# Interval joins -----------------------------------------------------------


def test_interval_join_is_brute_force(spark):
    rng = random.Random(4)
    make = lambda n, base: [(base + i, rng.choice(["a", "b", None]), (s := rng.randint(-50, 400)), s + rng.choice([0, 1, 3, 40, 200])) for i in range(n)]
    left, right = make(120, 0), make(120, 1000)
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    a = spark.createDataFrame(left, "i long, k string, start int, end int")
    b = spark.createDataFrame(right, "j long, k string, other_start int, other_end int")
    for width in (1, 7, 64, 5000):
        got = intervals.overlapping(a, b, ["k"], width)
        assert sorted((r.i, r.j) for r in got.collect()) == want and got.columns == ["i", "k", "start", "end", "j", "other_start", "other_end"]
    with pytest.raises(ValueError):
        intervals.overlapping(a, b, ["k"], 0)


def test_one_hot_document_is_split(spark):
    spans = spark.range(20_000).select(F.lit("d").alias("k"), (F.col("id") * 10).alias("other_start"), (F.col("id") * 10 + 30).alias("other_end"))
    places = spark.range(20_000).select(F.lit("d").alias("k"), (F.col("id") * 10 + 3).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    got = intervals.overlapping(places, spans, ["k"], 256)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and got.count() == 3 * 20_000 - 3


def test_mapping_without_a_document_ends_the_job(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 6, 0)], "doc_id long, chunk_index int, length int, overlap int")
    evidence = spark.createDataFrame([(5, 2, "text")], "evidence_id long, doc_id long, content string")
    with pytest.raises(Exception, match="no document"):
        mapping.locate(evidence, docs, mapping.spans(spans)).collect()


# Quota --------------------------------------------------------------------

LOG = "user_id string, event_id long, request_id string, kind string, day string, at double, to_midnight double"


def test_quota_in_event_order(spark):
    steps = [
        # busy leaves no trace: the minute and the day aren't touched
        ("r1", "acquire", "d1", 0, ("granted", None, 1)), ("r2", "acquire", "d1", 1, ("concurrent", 5, 1)), ("r2", "release", "d1", 2, ("ignored", None, 1)), ("r1", "release", "d1", 3, ("released", None, 1)),
        ("r1", "release", "d1", 4, ("ignored", None, 1)), ("r3", "acquire", "d1", 5, ("granted", None, 2)), ("r3", "release", "d1", 6, ("released", None, 2)),
        # two a minute, and the place of what the minute refuses is given back
        ("r4", "acquire", "d1", 10, ("rate_limited", 50, 2)), ("r5", "acquire", "d1", 60, ("granted", None, 3)),
        # a refund counts once, and gives no minute back
        ("r5", "refund", "d1", 61, ("refunded", None, 2)), ("r5", "refund", "d1", 61.5, ("ignored", None, 2)), ("r5", "release", "d1", 62, ("released", None, 2)),
        ("r6", "acquire", "d1", 63, ("rate_limited", 2, 2)), ("r7", "acquire", "d1", 130, ("granted", None, 3)), ("r8", "acquire", "d1", 131, ("daily_quota", 77, 3)),
        # a new day counts anew; what still runs still takes its place, and its refund belongs to its day
        ("r9", "acquire", "d2", 200, ("concurrent", 5, 0)), ("r7", "refund", "d2", 201, ("refunded", None, 0)), ("r7", "release", "d2", 202, ("released", None, 0)), ("r9", "acquire", "d2", 203, ("granted", None, 1)),
    ]
    rows = [(u, i, r, k, d, float(t), 77.9) for u in ("a", "b") for i, (r, k, d, t, _) in enumerate(steps)]
    random.Random(1).shuffle(rows)
    got = {(r.user_id, r.event_id): (r.outcome, r.wait, r.used) for r in quota.quota(spark.createDataFrame(rows, LOG), per_day=3, at_once=1, per_minute=2).collect()}
    assert got == {(u, i): want for u in ("a", "b") for i, (*_, want) in enumerate(steps)}


def test_quota_query_has_every_outcome(spark):
    got = {r.outcome for r in registry.queries()["quota_outcomes"](spark, "/root/testdata/sf0.01").select("outcome").distinct().collect()}
    assert got == {"granted", "daily_quota", "concurrent", "rate_limited", "released", "refunded", "ignored"}


# Summaries ----------------------------------------------------------------

MESSAGES = "session_id long, seq long, role string, content string"


def talk(session, first, turns, words=60):
    return [(session, first + 2 * t + i, role, f"{role} {first + 2 * t} " + "word " * words) for t in range(turns) for i, role in enumerate(("user", "assistant"))]


def twin(rows, model, budget, keep):
    """Result rows of one session, by going through its messages again and again."""
    seen, upto, summary, out = [], 0, None, []
    for session, seq, role, content in sorted(set(rows), key=lambda r: r[1]):
        if role == "deleted":
            out.append((session, seq, None, None, "deleted"))
            break
        seen.append((seq, role, content))
        if role != "assistant":
            continue
        chosen = summaries.plan([m for m in seen if m[0] > upto], budget, keep)
        parts = [(r, c) for _, r, c in chosen if c.strip()]
        if parts:
            try:
                said = model(summary, parts).strip()
            except RuntimeError:
                said = ""
            if said:
                upto, summary = chosen[-1][0], said
            out.append((session, seq, upto or None, summary, "summarised" if said else "failed"))
    return out


def faulty_model():
    """A model that is down for one part of a talk; made here, so that workers needn't import this file."""

    def model(before, messages):
        if len(messages) > 1 and "user 7" in messages[-2][1]:
            raise RuntimeError("down")
        return f"{before or ''}+{len(messages)}:{messages[0][1][:8]}"

    return model


def test_summaries_are_the_twins(spark):
    rows = talk(1, 1, 9) + talk(2, 1, 2) + [(3, 1, "user", None), (3, 2, "assistant", " "), (3, 3, "user", "x" * 4000), (3, 4, "assistant", "y" * 9000), (3, 5, "user", "z"), (3, 6, "assistant", "z")] + talk(4, 1, 6) + [(4, 9, "deleted", None)]
    rows += rows[:5]  # repeated ones
    df = spark.createDataFrame(rows, MESSAGES)
    faulty = faulty_model()
    for model in (summaries.carried, faulty):
        got = sorted(((r.session_id, r.at_seq, r.upto, r.summary, r.status) for r in summaries.summaries(df, model, 200, 2).collect()), key=lambda r: r[:2])
        want = []
        for s in (1, 2, 3, 4):
            own = [(a, b, c, d or "") for a, b, c, d in rows if a == s]
            if s == 4:
                own = [r for r in own if r[1] < 9] + [(4, 9, "deleted", "")]
            cut = [(a, b, c, summaries.shortened(d)) for a, b, c, d in own]
            want += twin(cut if s == 3 else own, model, 200, 2)
        assert got == want
        assert ("failed" in {g[4] for g in got}) == (model is faulty)
    marks = {r.session_id: (r.upto, r.runs) for r in summaries.marks(summaries.summaries(df, summaries.carried, 200, 2)).collect()}
    assert 4 not in marks and marks[1][0] == 14


def test_summaries_of_a_stream_survive_restarts(spark, tmp_path):
    """Batches cut anywhere, a restart between them and a replayed batch give what one table gives."""
    faulty = faulty_model()
    rows = talk(1, 1, 8) + talk(2, 1, 5)
    rows.sort(key=lambda r: (r[1], r[0]))
    whole = sorted(map(tuple, summaries.summaries(spark.createDataFrame(rows, MESSAGES), faulty, 200, 2).collect()))
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = [rows[:7], rows[7:8], rows[:7], rows[8:20], rows[20:]]
    for k in range(0, 5, 2):  # each round is a query of its own that goes on from the checkpoint
        for i, own in enumerate(batches[k : k + 2], k):
            (source / f"{i:03}.json").write_text("".join(json.dumps(dict(zip(("session_id", "seq", "role", "content"), r, strict=True))) + "\n" for r in own))
            os.utime(source / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("maxFileAge", "10000d").json(str(source))
        query = summaries.summaries(stream, faulty, 200, 2).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        began = time.time()
        assert query.awaitTermination(120) and time.time() - began < 120
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == whole
