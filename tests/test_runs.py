import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import flows, passages, runs, sessions
from tessella.sources import versions


def units_of(spark, n):
    return spark.range(n).select(F.col("id").alias("question_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("question"))


def test_a_stopped_run_goes_on_and_ends_alike(spark, tmp_path):
    units, calls = units_of(spark, 60), []

    def work(rows):
        calls.append(sorted(r.question_id for r in rows.collect()))
        return {"records": rows.select("question_id", F.length("question").alias("n")), "stages": rows.select("question_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("stage"))}

    whole = runs.run_units(spark, str(tmp_path / "whole"), {"k": 1}, units, work, batches=3)
    assert whole.note["state"] == runs.COMPLETE
    path = str(tmp_path / "stopped")
    part = runs.run_units(spark, path, {"k": 1}, units, work, batches=3, stop_after=1)
    assert part.note["state"] == runs.RUNNING
    with pytest.raises(ValueError, match="isn't complete"):
        runs.finish(spark, path, {})
    with pytest.raises(ValueError, match="another configuration"):
        runs.run_units(spark, path, {"k": 2}, units, work, batches=3)

    def dies(rows):
        return {"records": rows.select("question_id", F.raise_error(F.lit("killed")).cast("int").alias("n")), "stages": rows.select("question_id", F.lit("a").alias("stage"))}

    with pytest.raises(Exception, match="killed"):
        runs.run_units(spark, path, {"k": 1}, units, dies, batches=3)
    assert versions.latest(spark, path).version == part.version
    calls.clear()
    rest = runs.run_units(spark, path, {"k": 1}, units, work, batches=3)
    assert rest.note == whole.note and len(calls) == 2 and not set(sum(calls, [])) & {r.question_id for r in part.read(spark, "done").collect()}
    for name in ("records", "stages", "done"):
        assert sorted(map(tuple, rest.read(spark, name).collect())) == sorted(map(tuple, whole.read(spark, name).collect())), name
    calls.clear()
    assert runs.run_units(spark, path, {"k": 1}, units, work, batches=3).version == rest.version and not calls
    last = runs.finish(spark, path, {"summary": rest.read(spark, "records").agg(F.sum("n").alias("n"))})
    assert runs.finish(spark, path, {"summary": last.read(spark, "summary")}).rows("summary") == 1


def test_lost_and_doubled_units_are_errors(spark, tmp_path):
    units = units_of(spark, 9)
    lose = lambda rows: {"records": rows.where("question_id <> 4").select("question_id")}
    with pytest.raises(ValueError, match="without a record"):
        runs.run_units(spark, str(tmp_path / "a"), {}, units, lose)
    for bad in (units.unionByName(units.limit(1)), units.unionByName(units.limit(1).withColumn("question_id", F.lit(None).cast("long")))):
        with pytest.raises(ValueError, match="an id each"):
            runs.run_units(spark, str(tmp_path / "b"), {}, bad, lose)
    keep = lambda rows: {"records": rows.select("question_id")}
    assert runs.run_units(spark, str(tmp_path / "c"), {}, units.limit(0), keep).note["state"] == runs.COMPLETE


def test_retrieval_run_has_failures_as_records(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i // 4, i % 4, f"word{i % 5} sea {i}", 9) for i in range(24)], "key long, chapter long, chunk_index long, content string, tokens int")
    vectors = chunks.select("key", "chapter", F.array((F.col("key") % 7).cast("double"), F.lit(1.0)).alias("embedding"))
    units = spark.createDataFrame([(1, "a", "full", "word1 sea", [1.0, 1.0], 0, 99, None), (2, "a", "past", "word2 sea", [2.0, 1.0], 0, 5, 2), (3, "b", "full", "down", [1.0, 0.0], 0, 99, None)], "question_id long, type string, level string, question string, vector array<double>, low long, high long, progress long")
    evidence = spark.createDataFrame([(1, 1), (1, None), (2, 2), (3, 3)], "question_id long, key long")

    def scorer(question, texts):
        if question == "down":
            raise RuntimeError("no scores")
        return [(i, float(-i)) for i in range(len(texts))]

    done = runs.run_units(spark, str(tmp_path / "r"), {}, units, runs.retrieval_work(chunks, vectors, evidence, scorer), batches=1)
    got = {r.question_id: r for r in done.read(spark, "records").collect()}
    assert got[3].error == "RuntimeError: no scores" and got[3].assembled == [] and (got[3].hit, got[3].mapped, got[3].total) == (0, 1, 1) and got[3].fused
    assert got[1].error is None and (got[1].mapped, got[1].total) == (1, 2) and got[1].keys == [1]
    for i in (1, 2):
        assert got[i].rerank == got[i].fused[:24] and got[i].hit == len(set(got[i].keys) & set(got[i].assembled))
        assert got[i].leak == (0 if i == 1 else sum(k // 4 > 2 for k in got[i].assembled))
    summary = runs.retrieval_summary(done.read(spark, "records"))
    assert {r.type: r.questions for r in summary["summary"].collect()} == {None: 3, "a": 2, "b": 1}
    assert 3 in {r.question_id for r in summary["failures"].collect()}


# Throttles that fold only what can reach a limit ---------------------------


def test_rate_limit_is_the_plain_fold(spark):
    rng, rows = random.Random(3), []
    for user in range(40):
        at = 0.0
        for i in range(rng.randint(0, 60)):
            at += rng.choice([0.0, 1.0, 5.0, 20.0, 300.0]) if user % 2 else 100.0
            rows.append((user, 1000 * user + i, at))
    for limit in (1, 3, 5):
        want = {}
        for user in range(40):
            held = []
            for _, event, at in sorted(r for r in rows if r[0] == user):
                held = [t for t in held if at - t < 60]
                want[event] = len(held) < limit
                if want[event]:
                    held.append(at)
        for batch in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {r.event_id: r.accepted for r in sessions.rate_limited(spark.createDataFrame(rows, "user_id long, event_id long, at double"), limit).collect()}
            assert got == want
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_throttle_folds_only_who_can_be_locked(spark):
    rng = random.Random(5)
    rows = [(f"a{k}", float(t), rng.random() < (0.9 if k % 3 == 0 else 0.2)) for k in range(12) for t in sorted(rng.sample(range(20_000), 40))]
    got = {(r.address, r.at): r.state for r in flows.throttled(spark.createDataFrame(rows, "address string, at double, failed boolean"), most=3, window_s=900.0, lock_s=700.0).collect()}
    want = {}
    for k in range(12):
        failures, until = [], float("-inf")
        for _, at, failed in sorted(r for r in rows if r[0] == f"a{k}"):
            if at < until:
                want[f"a{k}", at] = "locked"
                continue
            want[f"a{k}", at] = "failed" if failed else "ok"
            failures = [t for t in failures if at - t < 900] + [at] if failed else []
            if len(failures) >= 3:
                failures, until = [], at + 700
    assert got == want and set(want.values()) == {"locked", "failed", "ok"}


# Passages ------------------------------------------------------------------


@pytest.mark.parametrize("bits", [15, 20, 29])
def test_passages_are_the_same_with_any_map(spark, monkeypatch, bits):
    """A small map lets more windows through; the join settles them."""
    monkeypatch.setattr(passages, "MAP_BITS", bits)
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["red", "blue", "sea", "tree", "漢字", "😀"]) for _ in range(n))
    shared = [words(30) for _ in range(4)]
    texts = {i: words(20) + (rng.choice(shared) if i % 3 == 0 else "") + words(5) for i in range(60)} | {90: None, 91: "", 92: "x" * 59, 93: shared[0][:60]}
    known = [*shared, None, "short"]
    windows = {p[i : i + 60] for p in shared for i in range(len(p) - 59)}
    want = {}
    for k, t in texts.items():
        hits = [i for i in range(len(t or "") - 59) if t[i : i + 60] in windows]
        if hits:
            want[k] = (hits[0], len(hits))
    got = passages.overlaps(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(t,) for t in known], "text string"))
    assert {r.doc_id: (r.first_offset, r.windows) for r in got.collect()} == want and len(want) >= 20
