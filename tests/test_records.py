import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import markup, records as R
from tessella.operators import evaluation, models, retrieval, sessions, store


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


SCHEMA = {
    "type": "object", "required": ["id", "level"], "additionalProperties": False,
    "properties": {"id": {"type": "string", "minLength": 2, "pattern": "^q[0-9]+$"}, "level": {"enum": ["past", "full"]}, "progress": {"type": "integer", "minimum": 1, "maximum": 9}, "tags": {"type": "array", "minItems": 1, "items": {"type": "string"}}},
    "allOf": [{"if": {"properties": {"level": {"const": "past"}}}, "then": {"required": ["progress"]}, "else": {"not": {"required": ["progress"]}}}],
}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"id": "q1", "level": "past", "progress": 3}, []),
        ({"id": "q1", "level": "past"}, ["$.progress: required"]),
        ({"id": "q1", "level": "full", "progress": 3}, ["$: not"]),
        ({"id": "q1\n", "level": "full"}, ["$.id: pattern"]),
        ({"id": "q", "level": 1, "more": None}, ["$.id: minLength", "$.id: pattern", "$.level: enum", "$.more: additionalProperties"]),
        ({"id": "q1", "level": "past", "progress": True}, ["$.progress: type"]),
        ({"id": "q1", "level": "past", "progress": 10}, ["$.progress: maximum"]),
        ({"id": "q1", "level": "full", "tags": []}, ["$.tags: minItems"]),
        ({"id": "q1", "level": "full", "tags": ["a", 1]}, ["$.tags[1]: type"]),
        ([], ["$: type"]),
    ],
)
def test_schema_problems(value, want):
    assert sorted(p for p in R.problems(value, SCHEMA)) == want


def test_schema_column_and_unknown_keywords(spark):
    assert one(spark, '{"id": "q1", "level": "full"}', lambda c: R.schema_problems(c, SCHEMA)) == []
    assert one(spark, "{", lambda c: R.schema_problems(c, SCHEMA)) == ["$: not json"]
    assert one(spark, None, lambda c: R.schema_problems(c, SCHEMA)) == ["$: not json"]
    with pytest.raises(ValueError, match="/allOf/0/oneOf"):
        R.schema_problems(F.lit(""), {"allOf": [{"oneOf": []}]})


GOOD = {"verdict": "pass", "supported": True, "citations_valid": True, "complete": False, "refusal_correct": True, "issues": ["x"], "reason": "y", "extra": 1}


def test_schema_of_additional_fields_and_strict_integers():
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 2}}, "additionalProperties": {"type": "string", "minLength": 2}}
    assert list(R.problems({"n": 1.0, "a": "x", "b": "xy", "c": 1}, schema)) == ["$.n: type", "$.a: minLength", "$.c: type"]
    assert list(R.problems({"n": 1}, schema)) == ["$.n: minimum"] and list(R.problems({"n": True}, schema)) == ["$.n: type"]
    assert R.unsupported({"additionalProperties": {"oneOf": []}}) == ["/additionalProperties/oneOf"]
    assert list(R.problems({"x": 1}, {"additionalProperties": True})) == []


def test_verdict_is_strict(spark):
    got = one(spark, json.dumps(GOOD), R.verdict)
    assert (got.verdict, got.complete, got.issues, got.reason) == ("pass", False, ["x"], "y")
    assert one(spark, json.dumps(GOOD | {"issues": []}), R.verdict).issues == []
    bad = [GOOD | {"verdict": "maybe"}, GOOD | {"supported": 1}, GOOD | {"issues": "x"}, GOOD | {"issues": ["x", 1]}, GOOD | {"reason": None}, {k: v for k, v in GOOD.items() if k != "complete"}, [GOOD]]
    for text in [*map(json.dumps, bad), f"```json\n{json.dumps(GOOD)}\n```", "", None]:
        assert one(spark, text, R.verdict) is None, text


def test_mapper_answer(spark):
    got = one(spark, 'Sure: {"chunk_key": "a", "alternative_chunk_key": " ", "confidence": 0.7, "reason": "r"} ok', R.mapper_answer)
    assert (got.chunk_key, got.alternative_chunk_key, got.confidence) == ("a", None, 0.7)
    for text in ('{"chunk_key": 1, "alternative_chunk_key": null, "confidence": 1, "reason": "r"}', '{"chunk_key": null, "alternative_chunk_key": null, "confidence": true, "reason": "r"}', '{"chunk_key": null, "alternative_chunk_key": null, "confidence": 1, "reason": " "}', "none", None):
        assert one(spark, text, R.mapper_answer) is None, text


def test_string_guard_and_splice(spark):
    assert one(spark, json.dumps({"a": ["x", {"b": "汉" * 7}]}), R.longest_string) == 7
    assert one(spark, "no", R.longest_string) is None
    with pytest.raises(Exception, match="more than 5 characters"):
        one(spark, '["abcdef"]', lambda c: R.guarded(c, 5))
    add = lambda c: R.splice(c, n=F.lit(1), s=F.lit('a"'))
    assert json.loads(one(spark, '{"x": 2} ', add)) == {"x": 2, "n": 1, "s": 'a"'}
    assert json.loads(one(spark, "{}", add)) == {"n": 1, "s": 'a"'}
    assert one(spark, "[DONE]", add) == "[DONE]"


def test_overrides():
    base = {"ask_top_k": 12, "ask_max_chapters": 8, "ask_chunks_per_chapter": 4, "budget": 6000, "rrf_k": 60}
    assert R.overrides(base, {"ask_top_k": 16})["ask_top_k"] == 16
    for bad in ({"other": 1}, {"ask_top_k": 33}, {"budget": 4799}, {"rrf_k": 0}):
        with pytest.raises(ValueError):
            R.overrides(base, bad)


def test_markdown_blocks(spark):
    text = "# One\n### Three\nline a\nline b\n\n> q1\n> q2\n- x\n- y\n\n3. c\n4. d\n***\n```py\n# no heading\n```\nend"
    got = [(b.kind, b.level, b.lines) for b in one(spark, text, markup.blocks)]
    assert got == [("heading", 2, ["One"]), ("heading", 3, ["Three"]), ("paragraph", 0, ["line a", "line b"]), ("quote", 0, ["q1", "q2"]), ("ul", 0, ["x", "y"]), ("ol", 3, ["c", "d"]), ("hr", 0, [""]), ("code", 0, ["# no heading"]), ("paragraph", 0, ["end"])]
    assert one(spark, None, markup.blocks) == [] and one(spark, " \n", markup.blocks) == []


def test_inline_and_segments(spark):
    assert [(s.kind, s.text) for s in one(spark, "a **b** `c` *d* **e", markup.inline)] == [("plain", "a "), ("bold", "b"), ("plain", " "), ("code", "c"), ("plain", " *d* **e")]
    assert [(s.kind, s.text) for s in one(spark, "**a `b` c**`d`**`e`**", markup.inline)] == [("bold", "a "), ("code", "b"), ("bold", " c"), ("code", "d"), ("code", "e")]
    t = "x[C1][C02] y\n[C0]"
    got = one(spark, t, markup.citation_segments)
    assert "".join(s.piece for s in got) == t and [s.chapter for s in got] == [None, 1, None, 0]


def test_render_fills_once(spark):
    fill = lambda c: markup.render(c, a=F.lit("{b}"), b=F.lit("2"))
    assert one(spark, "x {a} {b}{a} {z}", fill) == "x {b} 2{b} {z}"
    with pytest.raises(Exception, match="placeholder is missing"):
        one(spark, "x {a}", fill)


def test_image_key(spark):
    for path, want in [("images/a.png", "images/a.png"), ("./images/x/../b.JPG", "images/x/../b.JPG"[:7] + "b.JPG"), ("images/../c.png", None), ("/images/a.png", None), ("images\\a.png", None), ("images/%2e.png", None), ("C:images/a.png", None), ("images/a.exe", None), ("", None), (None, None), ("../images/a.png", None)]:
        assert one(spark, path, lambda c: markup.image_key(c)) == want, path


def test_stand_ins(spark):
    v = models.hash_vectors(["a", "b"])
    assert v == models.hash_vectors(["a", "b"]) and v[0] != v[1] and all(math.isclose(sum(x * x for x in y), 1) for y in v)
    df = spark.createDataFrame([("k1", "a", None), ("k2", None, None), ("k3", "b", [1.0])], "chunk_key string, content string, embedding array<double>")
    got = {r.chunk_key: r.embedding for r in models.backfill(df).collect()}
    assert got == {"k1": v[0], "k2": None}
    with pytest.raises(Exception, match="another dimension"):
        models.backfill(df, dim=63).collect()


def test_generate_isolates_failures(spark):
    def model(prompts):
        if "bad" in prompts:
            raise RuntimeError("provider")
        return [f" [INSUFFICIENT] {p}" if p == "refuse" else p for p in prompts]

    df = spark.createDataFrame([("ok",), ("bad",), ("refuse",)], "t string").coalesce(1)
    got = [tuple(r.x) for r in df.select(models.generate(F.col("t"), model).alias("x")).collect()]
    assert got == [("answered", "ok"), ("generation_failed", ""), ("insufficient_evidence", "")]


def test_rewrite_outcomes(spark):
    df = spark.createDataFrame([("q", 0, "new"), ("q", 1, "\n new \nmore"), ("q", 1, " "), ("q", 1, None), ("q", 1, "q"), ("q", 1, "x" * 2001)], "q string, n int, r string")
    got = [tuple(r.x) for r in df.select(models.rewrite(F.col("q"), F.col("n"), F.col("r")).alias("x")).collect()]
    assert got == [("q", "skipped"), ("new", "rewritten"), ("q", "failed"), ("q", "failed"), ("q", "unchanged"), ("q", "failed")]


def test_fallback_mapping(spark):
    df = spark.createDataFrame([(1, ["a"], ("a", 0.9)), (2, ["a"], ("a", 0.4)), (3, ["a"], ("b", 0.9)), (4, ["a"], None)], "evidence_id int, candidates array<string>, answer struct<chunk_key:string,confidence:double>")
    assert sorted(map(tuple, models.fallback_mapping(df).collect())) == [(1, "matched", "a", 0.9), (2, "low_conf", "a", 0.4), (3, "unmatched", None, 0.0), (4, "unmatched", None, 0.0)]


def test_store_changes(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, d string, v int")
    new = spark.createDataFrame([("a", None, 3, 1), ("a", None, 4, 2), ("c", "x", 5, 1)], "k string, d string, v int, at int")
    assert sorted(store.upsert_last(old, new, ["k", "d"], "at").collect(), key=str) == sorted([("a", None, 4), ("b", "x", 2), ("c", "x", 5)], key=str)
    assert store.purge(old, d="x", k=None).count() == 1 and store.purge(old).count() == 0 and store.purge(old, d="y").count() == 2
    usage = spark.createDataFrame([("2024-01-01", 1, 1), ("2024-02-20", 2, 3), ("never", 3, 1)], "day string, user_id long, turns long")
    back = spark.createDataFrame([("2024-01-01", 1, "r"), ("2024-01-01", 1, "r"), ("2024-02-20", 2, "s"), ("2024-02-20", 9, "t")], "day string, user_id long, request_id string")
    assert {r.user_id: r.turns for r in store.refund(usage, back).collect()} == {1: 0, 2: 2, 3: 1}
    assert {r.user_id for r in store.retain(usage, F.lit("2024-03-01").cast("date")).collect()} == {2, 3}
    now = F.lit("2024-01-02").cast("timestamp")
    logins = spark.createDataFrame([(1, "2024-01-01T00:00:00Z"), (2, "2024-01-03T00:00:00Z"), (3, "?")], "id int, expires_at string")
    assert [r.id for r in store.live_logins(logins, now).collect()] == [2]
    accounts = logins.withColumnRenamed("expires_at", "created_at")
    assert [r.id for r in store.live_accounts(accounts, now, 1).collect()] == [2, 3] and store.live_accounts(accounts, now).count() == 3
    assert [r.k for r in store.page_after(old, "k", "a", 5).collect()] == ["b"] and store.page_after(old, "k", None, 1).count() == 1


def test_neighbours_prefer_the_one_before(spark):
    chunks = spark.createDataFrame([(f"c{i}", 1, i, 10) for i in range(5)], "key string, chapter int, chunk_index int, tokens int")
    hits = spark.createDataFrame([(1, "c2", 1, 2, 1, 10, True), (2, "c0", 1, 0, 1, 10, True), (3, "c1", 1, 1, 1, 10, True), (3, "c0", 1, 0, 2, 10, True)], "query_id int, key string, chapter int, chunk_index int, rank int, tokens int, in_realm boolean")
    got = {(r.query_id, r.place): (r.key, r.source) for r in retrieval.assemble_context(hits, chunks).collect()}
    assert got == {(1, 1): ("c1", "neighbor"), (1, 2): ("c2", "hit"), (2, 1): ("c0", "hit"), (2, 2): ("c1", "neighbor"), (3, 1): ("c0", "hit"), (3, 2): ("c1", "hit"), (3, 3): ("c2", "neighbor")}
    tight = {(r.query_id, r.key) for r in retrieval.assemble_context(hits, chunks, budget=10).collect()}
    assert tight == {(1, "c2"), (2, "c0"), (3, "c1")}
    assert {r.source for r in retrieval.assemble_context(hits, chunks, per_chapter=1).collect()} == {"hit"}


def test_evaluation_stages(spark):
    df = spark.createDataFrame([(1, 1, 1, 0), (0, 1, 1, 0), (0, 0, 1, 0), (1, 1, 1, 2)], "hit int, mapped int, total int, leak int")
    c = {k: F.col(k) for k in df.columns}
    assert [r[0] for r in df.select(evaluation.retrieval_stage(c)).collect()] == [None, "retrieval", "mapping", "leak"]
    rows = spark.createDataFrame([("generation_failed", [], True), ("answered", ["[C9]"], False), ("answered", [], True), ("insufficient_evidence", [], True)], "status string, citation_out_of_range array<string>, expect_refusal boolean")
    assert [r[0] for r in rows.select(evaluation.answer_stage({k: F.col(k) for k in rows.columns})).collect()] == ["generation", "citation", "refusal", None]
    table = spark.createDataFrame([(1, "a|b", None)], "place int, x string, y int")
    assert evaluation.markdown_table(table, "x", "y").first().line == r"| a\|b | ? |"


def test_upstream_counts_utf16_units(spark):
    mark = sessions.CUT_MARK
    texts = ["a" * 20, "a" * 21, "😀" * 10, "😀" * 11, "b" + "😀" * 10, " \n", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq int, content string")
    room = 20 - len(mark)
    got = {r.seq: r.content for r in sessions.upstream(df, 20).collect()}
    cut = lambda t: t.encode("utf-16-be")[: 2 * room].decode("utf-16-be", "ignore") + mark
    assert got == {0: texts[0], 1: cut(texts[1]), 2: texts[2], 3: cut(texts[3]), 4: cut(texts[4])}
