import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import answering, evaluation, flows, mapping, sessions, store
from tessella.plans import registry
from tessella.sources import corpus


def rows_of(spark, kept, reranked=(), failed=()):
    """Stage rows: kept, reranked (query_id, key), and failed (query_id)."""
    out = [(q, "assembled", k, i, None, None, "hit", i) for q, keys in kept.items() for i, k in enumerate(keys, 1)]
    out += [(q, "reranked", k, 1, 0.5, None, None, None) for q, k in reranked]
    out += [(q, "failed", None, None, None, "RuntimeError: down", None, None) for q in failed]
    return spark.createDataFrame(out, "query_id long, stage string, key long, rank long, score double, reason string, source string, place long")


def test_streams_of_answers(spark):
    chunks = spark.createDataFrame([(10 * c + i, c, f"text {c} {i}", 7) for c in range(4) for i in range(3)], "key long, chapter int, content string, tokens int")
    requests = spark.createDataFrame(
        [(1, "full", None, 0, 9, "q one", None), (2, "past", 3, 0, 3, "refuse", None), (3, "full", None, 0, 9, "empty", None), (4, "full", None, 0, 9, "down", None), (5, "full", None, 0, 9, "lost", None), (6, "full", None, 0, 9, "old", ("new", "rewritten"))],
        "request_id long, level string, progress int, low int, high int, question string, rewrite struct<question: string, outcome: string>",
    )
    stages = rows_of(spark, {1: [20, 10], 2: [10], 4: [10], 6: [30]}, [(1, 20), (1, 10)], [5])

    def model(prompts):
        for p in prompts:
            assert not p.endswith(("empty", "lost"))  # without context, or without retrieval, nobody is asked
        if any(p.endswith("down") for p in prompts):
            raise RuntimeError("down")
        return ["  [INSUFFICIENT] no" if p.endswith("refuse") else "x" * 250 if p.endswith("q one") else p.rsplit("\n", 1)[1] for p in prompts]

    events = answering.answer_events(requests, stages, chunks, model)
    assert {r.request_id: r.error for r in flows.order_errors(events).collect()} == dict.fromkeys(range(1, 7))
    got = {}
    for r in events.orderBy("request_id", "seq").collect():
        got.setdefault(r.request_id, []).append((r.name, json.loads(r.payload)))
    names = {k: [n for n, _ in v] for k, v in got.items()}
    ends = {k: v[-1] for k, v in got.items()}
    assert ends[1][1]["status"] == "answered" and names[1].count("answer_delta") == 2 and ends[1][1]["context_chapters"] == [1, 2] and ends[1][1]["usage"] == {"context_tokens": 14}
    for k in (2, 3):
        assert ends[k][1]["status"] == "insufficient_evidence" and [p["text"] for n, p in got[k] if n == "answer_delta"] == [answering.REFUSED]
    assert ends[2][1]["context_chapters"] == [1] and ends[3][1]["context_chapters"] == []
    assert ends[4] == ("query_error", {"request_id": "4", "code": "GENERATION_FAILED", "message": "the model failed"}) and "generation_started" in names[4]
    assert names[5] == ["query_started", "query_error"] and ends[5][1]["code"] == "RETRIEVAL_FAILED"
    assert "rewrite_completed" in names[6] and "rewrite_completed" not in names[1]
    assert dict(got[6])["rewrite_completed"] == {"status": "rewritten", "original": "old", "effective": "new"} and dict(got[6])["answer_delta"] == {"text": "new"}
    assert dict(got[1])["rerank_completed"]["output_count"] == 2 and [c["chapter"] for c in dict(got[1])["context_assembled"]["chunks"]] == [2, 1]
    wire = {r.request_id: r.stream for r in corpus.frames(events).collect()}
    assert wire[1].endswith("data: [DONE]\n\n") and wire[4].count("[DONE]") == 0 and "event: error\n" in wire[4]


def test_changes_are_applied_in_order(spark):
    rng = random.Random(7)
    old = {k: (f"t{k}", k) for k in range(0, 30, 2)}
    log = [(n, rng.randrange(32), rng.choice(["insert", "update", "update", "update", "delete"]), rng.choice([None, f"n{n}"]), rng.choice([None, n])) for n in range(300)]
    want = dict(old)
    for _, key, kind, title, seen in log:
        if kind == "insert":
            want[key] = (title, seen)
        elif kind == "delete":
            want.pop(key, None)
        elif key in want:
            want[key] = tuple(b if b is not None else a for a, b in zip(want[key], (title, seen), strict=True))
    rng.shuffle(log)
    got = store.change(spark.createDataFrame([(k, *v) for k, v in old.items()], "key long, title string, seen long"), spark.createDataFrame(log, "at long, key long, kind string, title string, seen long"), "key", "at")
    assert {r["key"]: (r.title, r.seen) for r in got.collect()} == want


def test_slices_are_held_against_their_texts(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz")], "doc_id long, text string")
    good = [(1, 0, "abcdef", 0), (1, 1, "efghij", 2), (2, 0, "xyz", 0)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, chunk_index int, content string, overlap int")
    assert [(r.start, r.end) for r in mapping.frozen_slices(frame(good), docs).orderBy("doc_id", "chunk_index").collect()] == [(0, 6), (4, 10), (0, 3)]
    for bad, message in (
        ([(3, 0, "a", 0)], "isn't there"), ([(1, 0, "abcdex", 0), good[1]], "isn't what stands"), ([good[0]], "goes on"), ([(1, 0, "abcd", 0), (1, 1, "efghij", 2)], "isn't what stands|isn't the end"),
    ):
        with pytest.raises(Exception, match=message):
            mapping.frozen_slices(frame(bad), docs).collect()


def test_subsets_name_known_questions(spark):
    questions = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r.n for r in evaluation.subset(questions, ids("c", "a", "c")).collect()) == [1, 3]
    with pytest.raises(Exception, match="no question z"):
        evaluation.subset(questions, ids("a", "z")).collect()


def test_stored_token_counts_count(spark):
    rows = [(1, 1, "user", "x" * 100, 7), (1, 2, "assistant", "y" * 100, None)]
    df = spark.createDataFrame(rows, "session_id long, seq long, role string, content string, token_count int")
    assert [r.tokens for r in sessions.turns(df).orderBy("seq").collect()] == [7, 30]
    assert [r.tokens for r in sessions.turns(df.drop("token_count")).orderBy("seq").collect()] == [30, 30]


def test_source_trees_of_large_sources_and_null_texts(spark, tmp_path):
    """A source of more than 16 ** 3 documents has a hash for each 4,096, as in the SQL; null texts take a place."""
    import duckdb

    rows = [(i, None if i % 5 == 0 else f"t{i % 900}", "large" if i > 40 else "small" if i > 3 else "none") for i in range(4500)]
    rows = [(i, None if s == "none" else t, s) for i, t, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()["source_trees"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.sql(registry.oracles()["source_trees"]).fetchall())
    assert len(got) == 4
