import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessella.sources import corpus
from tessella.streaming import limits


def test_corpus_lines_are_numbered_and_checked(spark, tmp_path):
    row = lambda i, text: json.dumps({"id": f"x{i}", "vol": "v", "title": "t", "url": "u", "images": [], "text": text})
    (tmp_path / "index.jsonl").write_text("".join(row(i, f"text {i} ") + "\n" for i in range(1, 40)))
    rows = corpus.read_corpus(spark, str(tmp_path / "index.jsonl")).orderBy("chapter_index").collect()
    assert [r.chapter_index for r in rows] == list(range(1, 40)) and rows[4].text == "text 5" and rows[4].chapter_id == "book:1:chapter:5"
    (tmp_path / "bad.jsonl").write_text(row(1, " ") + "\n")
    with pytest.raises(Exception, match="line 1"):
        corpus.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_questions_and_evidence(spark, tmp_path):
    q = {"id": "fact-1", "type": "fact", "must_cite_groups": [[{"chapter_id": "c1", "content": "a"}], [{"chapter_id": "c2", "content": "b"}]]}
    (tmp_path / "fact-1.json").write_text(json.dumps(q, indent=1))
    got = corpus.evidence(corpus.read_questions(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [(r.ordinal, r.chapter_id, r.content) for r in got] == [(0, "c1", "a"), (1, "c2", "b")]


def test_events_fold_and_frames(spark):
    rows = [("r", 1, "delta", '{"text":"a"}'), ("r", 2, "delta", '{"text":"b"}'), ("r", 3, "done", '{"status":"answered"}'), ("e", 1, "delta", '{"text":"a"}'), ("e", 2, "error", "{}"), ("n", 1, "delta", '{"text":"a"}')]
    events = spark.createDataFrame(rows, "request_id string, seq int, name string, payload string")
    got = {r.request_id: (r.status, r.text) for r in corpus.fold_events(events).collect()}
    assert got == {"r": ("answered", "ab"), "e": ("generation_failed", ""), "n": ("generation_failed", "")}
    assert {r.request_id: r.stream for r in corpus.frames(events).collect()}["r"].endswith('data: {"status":"answered"}\n\ndata: [DONE]\n\n')


def run_stream(spark, tmp_path, schema, batches, make, name):
    source = tmp_path / "in"
    source.mkdir()
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "10000d").json(str(source)))
    for i, rows in enumerate(batches):
        (source / f"{i:03}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(source / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:  # batches that only look for time-outs never end by themselves
        end = time.time() + 60
        while time.time() < end and spark.table(name).count() < sum(map(len, batches)):
            time.sleep(0.5)
        return spark.table(name).collect()
    finally:
        q.stop()


def test_rate_limit_stream(spark, tmp_path):
    at = [0, 10, 20, 30, 40, 50, 59, 60, 61, 200]
    batches = [[{"user_id": 1, "event_id": i, "at": float(t)} for i, t in enumerate(at)][k : k + 5] for k in (0, 5)]
    got = {r.event_id: r.accepted for r in run_stream(spark, tmp_path, "user_id long, event_id long, at double", batches, limits.rate_limit, "limited")}
    assert [got[i] for i in range(10)] == limits.accept([float(t) for t in at], [])[0] == [True] * 5 + [False, False, True, False, True]


def test_refusal_stream(spark, tmp_path):
    batches = [[{"request_id": "a", "seq": 1, "text": " [INS"}, {"request_id": "b", "seq": 1, "text": "[I"}], [{"request_id": "a", "seq": 2, "text": "UFFICIENT] no"}, {"request_id": "b", "seq": 2, "text": "t is] so"}]]
    rows = run_stream(spark, tmp_path, "request_id string, seq long, text string", batches, limits.answers, "answers")
    shown = {k: "".join(r.shown for r in sorted(rows, key=lambda r: r.seq) if r.request_id == k) for k in "ab"}
    assert shown == {"a": "", "b": "[It is] so"}
