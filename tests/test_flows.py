"""Hand cases of books, realms, streams, throttles, records and evaluation gates."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import catalog, evaluation, flows, passages, retrieval
from tessella.sources import corpus, versions
from tessella.sources.staging import staged


def test_keyword_search_with_allow_list_and_realms(spark):
    rng = random.Random(1)
    words = ["red", "blue", "sea", "tree", "Sun", "moon", "."]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for i in range(80)}
    asked = {0: "red sea", 1: "Sun Sun moon .", 2: "nothing here", 3: "tree"}
    chunks = spark.createDataFrame(list(texts.items()), "key long, content string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, question string")

    def brute(keep):
        docs, out = {i: t.split() for i, t in texts.items()}, {}
        avgdl = sum(map(len, docs.values())) / len(docs)
        for q, text in asked.items():
            scores = {}
            for i, ws in docs.items():
                s = 0.0
                for t in text.split():
                    df = sum(t in d for d in docs.values())
                    tf = ws.count(t)
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))
                if s > 0 and keep(q, i):
                    scores[i] = round(s, 9)
            out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        return out

    def got(**more):
        out = {q: [] for q in asked}
        for r in retrieval.bm25(chunks, queries, "key", "content", 5, **more).orderBy("query_id", "rank").collect():
            out[r.query_id].append((r.key, r.score))
        return out

    def same(a, b):
        assert {q: [k for k, _ in v] for q, v in a.items()} == {q: [k for k, _ in v] for q, v in b.items()}
        assert all(abs(x - y) < 2e-9 for q in a for (_, x), (_, y) in zip(a[q], b[q]))

    same(got(), brute(lambda q, i: True))
    same(got(allowed=chunks.where("key % 3 = 0").select("key")), brute(lambda q, i: i % 3 == 0))
    assert not any(got(allowed=chunks.limit(0).select("key")).values())
    realms = spark.createDataFrame([(0, 10, 40), (1, 0, 79), (3, 79, 79)], "query_id long, low long, high long")
    low = {0: (10, 40), 1: (0, 79), 3: (79, 79)}
    same(got(place="key", realms=realms), brute(lambda q, i: q in low and low[q][0] <= i <= low[q][1]))
    assert retrieval.bm25(chunks.limit(0), queries, "key", "content").count() == retrieval.bm25(chunks, queries.limit(0), "key", "content").count() == 0


def test_nearest_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    v[5] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "key long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "query_id long, vector array<double>")
    sims = {j: {i: round(float(v[i] @ q[j] / np.linalg.norm(v[i]) / np.linalg.norm(q[j])), 9) for i in range(300) if i != 5} for j in range(7)}
    for where, keep in ((None, lambda i: True), (F.col("key") % 2 == 0, lambda i: i % 2 == 0)):
        out = retrieval.nearest(vectors, queries, "key", "embedding", 4, where).orderBy("query_id", "rank").collect()
        want = [(j, i) for j in range(7) for i in sorted((i for i in sims[j] if keep(i)), key=lambda i: (-sims[j][i], i))[:4]]
        assert [(r.query_id, r.key) for r in out] == want
    with pytest.raises(Exception, match="differ in length"):
        retrieval.nearest(spark.createDataFrame([(1, [1.0])], "key long, embedding array<double>"), queries, "key", "embedding", 4).collect()


def test_window_hashes_tell_windows_apart():
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(3000))
    h = passages.window_hashes(text, 12)
    by = {}
    for i, x in enumerate(h.tolist()):
        by.setdefault(x, set()).add(text[i : i + 12])
    assert len(h) == 2989 and all(len(s) == 1 for s in by.values()) and len(by) == len({text[i : i + 12] for i in range(2989)})
    assert len(passages.window_hashes("abc", 12)) == 0


def test_walks_over_chains_gaps_and_circles(spark):
    rows = [(i, i + 1 if i < 99 else None) for i in range(100)] + [(200, 201), (201, 999), (300, 301), (301, 300)]
    links = spark.createDataFrame(rows, "key long, next long")
    heads = spark.createDataFrame([(0,), (98,), (99,), (200,), (300,), (777,)], "key long")
    got = {r.head: (r.reached, r.last) for r in catalog.walks(links, heads, lambda df: staged(df, "walk"), 50).collect()}
    assert got[0] == (100, 99) and got[98] == (2, 99) and got[99] == (1, 99) and 777 not in got
    assert got[200][1] is None and got[300][1] is None


def test_missing_keys_end_a_lookup(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    asked = lambda keys: spark.createDataFrame([(7, keys)], "query_id long, keys array<long>")
    assert [(r.place, r.v) for r in catalog.lookup_in_order(asked([2, 1, 2]), rows, "k").orderBy("place").collect()] == [(0, "b"), (1, "a"), (2, "b")]
    with pytest.raises(Exception, match="no row of the key 3"):
        catalog.lookup_in_order(asked([1, 3]), rows, "k").collect()


def test_streams_are_parsed_like_a_browser_does(spark):
    text = ": hello\r\nevent: delta\r\ndata: a\r\ndata:  b\r\n\r\nid: 4\ndata:x:y\n\nevent: empty\n\nevent: done\ndata: {}\n\ndata: [DONE]\n\nevent: late\ndata: z\n\n"
    df = spark.createDataFrame([(1, text), (2, "event: cut\ndata: off"), (3, "")], "id long, stream string")
    got = {(r.id, r.place): (r.event, r.data) for r in flows.parse_stream(df).collect()}
    assert got == {(1, 0): ("delta", "a\n b"), (1, 1): ("message", "x:y"), (1, 2): ("done", "{}"), (2, 0): ("cut", "off")}


def test_order_of_events(spark):
    whole = [n for n in flows.ORDER if n != flows.ERROR]
    lacking = lambda *gone: [n for n in whole if n not in gone]
    streams = {
        1: whole, 2: lacking("rewrite_completed"), 3: lacking("rerank_completed"), 4: ["query_done"], 5: ["query_started", "query_done"], 6: whole[:3], 7: [*whole, "query_done"], 8: [*whole, "answer_delta"],
        9: ["query_started", "what", "query_done"], 10: ["query_started", "query_error"], 11: ["query_error"], 12: [whole[1], whole[0], *whole[2:]], 13: [*whole[:8], "answer_delta", *whole[8:]], 14: [*whole[:9], "citation_ready", "query_done"],
    }
    rows = [(k, i, n) for k, names in streams.items() for i, n in enumerate(names)]
    got = {r.request_id: r.error for r in flows.order_errors(spark.createDataFrame(rows, "request_id long, seq long, name string")).collect()}
    assert got == {
        1: None, 2: None, 3: "event is missing", 4: "event is missing", 5: "event is missing", 6: "no end", 7: "several ends", 8: "event after the end",
        9: "unknown event", 10: None, 11: None, 12: "out of order", 13: None, 14: "event twice",
    }


def test_throttle_locks_and_forgets(spark):
    rows = [("a", float(t), f) for t, f in [(0, True), (100, True), (200, True), (300, True), (400, True), (500, False), (1300, False), (1301, True)]] + [("b", 0.0, True), ("b", 1.0, False), ("b", 2.0, True)]
    got = {(r.address, r.at): r.state for r in flows.throttled(spark.createDataFrame(rows, "address string, at double, failed boolean")).collect()}
    assert [got["a", float(t)] for t in (0, 100, 200, 300, 400, 500, 1300, 1301)] == ["failed"] * 5 + ["locked", "ok", "failed"]
    assert [got["b", t] for t in (0.0, 1.0, 2.0)] == ["failed", "ok", "failed"]


def test_records_are_read_strictly(spark, tmp_path):
    row = {"question_id": "q", "type": "fact", "level": "full", "hit": 1, "mapped": 1, "total": 2, "leak": 0, "keys": ["b", "a"], "difficulty": 3}
    write = lambda name, *lines: (tmp_path / name).write_text("".join(x + "\n" for x in lines)) and str(tmp_path / name)
    assert corpus.read_records(spark, write("a.jsonl", json.dumps(row))).first()["keys"] == ["b", "a"]
    for name, bad, message in (("b", {**row, "new": 1}, "unknown field new"), ("c", {**row, "hit": "x"}, "FAILFAST|MALFORMED|malformed"), ("d", {**row, "keys": [1, {"x": 2}], "hit": [1]}, "FAILFAST|MALFORMED|malformed")):
        with pytest.raises(Exception, match=message):
            corpus.read_records(spark, write(f"{name}.jsonl", json.dumps(bad))).collect()
    with pytest.raises(ValueError, match="no records"):
        corpus.read_records(spark, str((tmp_path / "e.jsonl").touch() or tmp_path / "e.jsonl"))
    with pytest.raises(Exception, match="unknown status"):
        corpus.read_records(spark, write("f.jsonl", '{"question_id":"q","status":"maybe"}'), "question_id string, status string").collect()
    lookup = corpus.read_mapping_lookup(spark, write("m.jsonl", '{"evidence_hash":"h","chunk_key":"k","status":"matched"}', '{"evidence_hash":"i","chunk_key":"l","status":"low_conf"}'))
    assert {tuple(r) for r in lookup.collect()} == {("h", "k"), ("i", None)}


def test_runs_are_written_whole_or_not_at_all(spark, tmp_path):
    good = spark.createDataFrame([("b", [("x", None)])], "z string, a array<struct<d: string, c: int>>")
    corpus.write_run(str(tmp_path / "run"), good, good.limit(0), good)
    assert [r.value for r in versions.latest(spark, str(tmp_path / "run")).read(spark, "records").collect()] == ['{"a":[{"c":null,"d":"x"}],"z":"b"}']
    bad = spark.createDataFrame([("b", [("x" * 501, None)])], "z string, a array<struct<d: string, c: int>>")
    with pytest.raises(Exception, match="too long"):
        corpus.write_run(str(tmp_path / "other"), good, good, bad)
    assert versions.latest(spark, str(tmp_path / "other")).version == 0


def test_dataset_hash_ignores_order(spark):
    import hashlib

    rows = [("b", 1, None), ("a", 2, ["x"])]
    df = spark.createDataFrame(rows, "id string, n int, l array<string>")
    want = hashlib.sha256(b'{"id":"a","l":["x"],"n":2}\n{"id":"b","l":null,"n":1}').hexdigest()
    assert corpus.dataset_hash(df) == corpus.dataset_hash(df.orderBy("n").select("l", "n", "id")) == want


def test_blank_lines_and_folders_without_questions_are_refused(spark, tmp_path):
    row = json.dumps({"id": "x", "vol": "v", "title": "t", "url": "u", "images": [], "text": "text"})
    (tmp_path / "i.jsonl").write_text(f"{row}\n\n{row}\n")
    with pytest.raises(Exception, match="line 2 is blank"):
        corpus.read_corpus(spark, str(tmp_path / "i.jsonl")).collect()
    folder = tmp_path / "golden"
    folder.mkdir()
    (folder / "schema.json").write_text("{}")
    with pytest.raises(ValueError, match="no questions"):
        corpus.read_questions(spark, str(folder))


def test_evaluation_gates(spark):
    record = spark.createDataFrame([("q", [1], [2], [1, 2], [1], [1], 1)], "question_id string, dense array<long>, keyword array<long>, fused array<long>, rerank array<long>, assembled array<long>, hit long")
    evidence = spark.createDataFrame([("q", "t", k) for k in (1, 2, 3, None)], "question_id string, type string, key long")
    assert {r.key: r.stage for r in evaluation.attribution(evidence, record, True).collect()} == {1: "assembled", 2: "fused", 3: "channel_missed", None: "unmapped"}
    with pytest.raises(Exception, match="no record of question r"):
        evaluation.attribution(evidence.withColumn("question_id", F.lit("r")), record).collect()
    with pytest.raises(Exception, match="don't reconcile"):
        evaluation.attribution(evidence, record.withColumn("hit", F.lit(2)), True).collect()
    a, b = spark.range(3).toDF("x"), spark.range(2).toDF("y")
    with pytest.raises(Exception, match="differ in length"):
        evaluation.zipped(a, b, "x", "y").collect()
    with pytest.raises(Exception, match="no recorded outcome"):
        evaluation.replay(a, spark.createDataFrame([(0, "o")], "x long, outcome string"), ["x"]).collect()


def test_token_slices_hold_a_batch_in_order():
    """Slices follow the number of tokens, not of rows, so a task's arrays don't grow with its batches."""
    import pyarrow as pa

    sizes = [3, 0, 4, 9, 1, 0, 0, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([["t"] * n for n in sizes])], names=["key", "ts"])
    for own in (batch, batch.slice(2, 5)):
        for most in (1, 5, 100):
            got = list(retrieval.token_slices(own, 1, most))
            assert pa.Table.from_batches(got).to_pylist() == own.to_pylist()
            assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= most for p in got)


def test_assembly_sorts_few_times_and_small_tasks(spark):
    """One order for a chapter and one for a query beside the hits' own; partitions follow the number of rows."""
    from tessella.plans import registry
    from tessella.sources.staging import dealt

    plan = registry.queries()["context_assembly"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    full = registry.queries()["context_assembly"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and full.count("Sort [") == 3 and full.count("Exchange ") == 1
    assert dealt(spark.range(1000), "id", rows=50).rdd.getNumPartitions() == 20


def test_assembly_caps_against_brute_force(spark):
    """Caps in their order, also with tied ranks, hits whose realm is unknown and more places than chapters."""
    import random

    rng = random.Random(5)
    rows = [(q, k, rng.randrange(6), rng.randrange(1, 15), rng.randrange(1, 40), rng.choice([True, True, True, False, None])) for q in range(60) for k in range(rng.randrange(1, 25))]
    hits = spark.createDataFrame(rows, "query_id long, key long, chapter int, rank int, tokens long, in_realm boolean")
    for chapters, per_chapter, top_k, budget in ((2, 2, 3, 80), (8, 4, 12, 6000), (1, 9, 9, 60)):
        want = {}
        for q in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[3], r[1]))
            inside = [r for r in own if r[5] is not False]
            best = {c: min(r[3] for r in inside if r[2] == c) for c in {r[2] for r in inside}}
            admitted = sorted(set(best.values()))[:chapters]
            n, taken, held = {}, 0, 0
            for r in own:
                if r[5] is False:
                    reason = "realm"
                elif best[r[2]] not in admitted:
                    reason = "chapter_cap"
                else:
                    n[r[2]] = n.get(r[2], 0) + 1
                    reason = "chapter_chunk_cap" if n[r[2]] > per_chapter else None
                if reason is None:
                    taken += 1
                    reason = "top_k_cap" if taken > top_k else None
                if reason is None:
                    held += r[4]
                    reason = "token_budget" if held > budget else None
                want[q, r[1]] = reason
        assert {(r.query_id, r.key): r.reason for r in retrieval.assemble(hits, chapters, per_chapter, top_k, budget).collect()} == want


def peak_mb(work) -> float:
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def best_of(batches, k):
    """The k best keys a query of what a task passes on."""
    import pyarrow as pa

    out: dict = {}
    for r in pa.Table.from_batches(batches).to_pylist():
        out.setdefault(r["query_id"], []).append((-r["score"], r["key"]))
    return {q: sorted(v)[:k] for q, v in out.items()}


def test_vectors_are_scored_in_slices(monkeypatch):
    """What a batch of vectors takes doesn't follow rows times queries; slices find what one product of all finds."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(10_000, 8)), retrieval.unit(rng.normal(size=(500, 8)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(np.arange(10_000) % 50), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 8).cast(pa.list_(pa.float64()))], names=["key", "place", "v"])
    run = lambda places=None, ids=500: retrieval.best_vectors([batch, batch.slice(9_000)], pa.array(range(ids)), q[:ids], places, 7)
    assert peak_mb(lambda: [None for _ in run()]) < 80
    for places in (None, np.array([[0, 9], [3, 3], [5, 1]])):
        whole = best_of(run(places, 3), 7)
        assert len(whole) == (3 if places is None else 2)
        monkeypatch.setattr(retrieval, "SCORE_SLICE", 40)
        assert best_of(run(places, 3), 7) == whole
        monkeypatch.undo()


def test_words_are_scored_in_slices(monkeypatch):
    """Weights are held for one block of queries, bounded by their tokens; blocks and slices of any size find the same."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    own = [np.sort(rng.choice(30_000, 100, replace=False)) for _ in range(2_000)]
    tokens = [np.sort(rng.choice(30_000, rng.integers(0, 60), replace=False)).astype(np.int32) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(np.arange(600) % 50), pa.array([len(t) + 5 for t in tokens], pa.int32()), pa.array(tokens, pa.list_(pa.int32())), pa.array([np.ones(len(t), np.int32) for t in tokens], pa.list_(pa.int32()))], names=["key", "place", "dl", "tokens", "tfs"])

    def run(n, places=None):
        ends = np.cumsum([len(t) for t in own[:n]])
        return retrieval.best_words([batch, batch.slice(500)], pa.array(range(n)), np.concatenate(own[:n]), np.ones(ends[-1]), ends, 35.0, places, 4)

    assert peak_mb(lambda: [None for _ in run(2_000)]) < 150
    for places in (None, np.array([[0, 9]] * 30)):
        whole = best_of(run(30, places), 4)
        brute: dict = {}
        for q in range(30):
            for i, t in enumerate(tokens):
                score = round(len(np.intersect1d(t, own[q])) / (1 + 1.5 * (0.25 + 0.75 * (len(t) + 5) / 35.0)), 9)
                if score > 0 and (places is None or i % 50 <= 9):
                    brute.setdefault(q, []).extend([(-score, i)] * (1 + (i >= 500)))
        assert {q: [k for _, k in v] for q, v in whole.items()} == {q: [k for _, k in sorted(v)[:4]] for q, v in brute.items()}
        monkeypatch.setattr(retrieval, "SCORE_SLICE", 9_000)
        monkeypatch.setattr(retrieval, "MAX_TOKENS", 1_000)
        assert best_of(run(30, places), 4) == whole
        monkeypatch.undo()
    blocks = retrieval.word_blocks(np.cumsum([3, 1, 1, 5_000_000, 1, 1]))
    assert blocks == [(0, 3), (3, 4), (4, 6)]


def test_drop_samples_sort_dealt_lines(spark):
    """Samples are counted over lines dealt by their number: no task's sort grows with the table."""
    from tessella.plans import registry

    plan = registry.queries()["drop_samples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Sort [") == 3 and plan.count("Exchange ") == 2


def test_assembly_of_tied_and_odd_lines(spark, tmp_path):
    """Lines of one price and number, which the SQL leaves open, come in one order however the table lies; fractions and nulls as in the SQL."""
    import random

    import duckdb
    from tessella.plans import registry

    rng = random.Random(7)
    own = lambda *xs: rng.choice([*xs, *xs, None])
    rows = [(rng.randrange(150), own(*range(8)), own(1, 2, 3), own(10.0, 12.5, 13.5, 27.4, 40.6), own(900.0, 901.5, 950.0, float("nan")), own(0.02, 0.05, 0.08, 0.09)) for _ in range(1200)]
    got = []
    for name, part in (("given", rows), ("turned", rows[::-1])):
        t = spark.createDataFrame(part, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
        t.coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got.append(sorted(map(tuple, registry.queries()["context_assembly"](spark, f"{tmp_path}/{name}").collect()), key=str))
    assert got[0] == got[1]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/given/lineitem.parquet/*.parquet')")
    given = "ORDER BY l_extendedprice DESC, l_linenumber)"
    sql = registry.oracles()["context_assembly"]
    assert sql.count(given) == 1
    settled = sql.replace(given, given[:-1] + ", l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_discount NULLS FIRST)")
    assert got[0] == sorted(con.execute(settled).fetchall(), key=str)
