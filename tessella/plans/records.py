"""Registered queries on contexts, models, prompts, keyed tables and evaluation records."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import markup, records as R
from ..operators import evaluation, models, retrieval, store
from .registry import messages, read, register


@register("""WITH raw AS (SELECT l_orderkey AS query_id, l_partkey AS key, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
    chunks AS (SELECT p_partkey AS key, p_partkey // 10 AS chapter, p_partkey % 10 AS chunk_index, p_size::BIGINT AS tokens FROM part),
    hits AS (SELECT query_id, key, chapter, chunk_index, tokens, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, key) AS rank FROM raw JOIN chunks USING (key)),
    a AS (SELECT *, min(rank) OVER (PARTITION BY query_id, chapter) AS best, row_number() OVER (PARTITION BY query_id, chapter ORDER BY rank) AS i, count(*) OVER (PARTITION BY query_id, chapter) AS size FROM hits),
    own AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS c FROM a QUALIFY c <= 4 AND i <= 2),
    wish AS (SELECT o.query_id, o.chapter, o.rank, o.key AS from_key, n.key, n.chunk_index, n.tokens, row_number() OVER (PARTITION BY o.query_id, o.key ORDER BY n.chunk_index) AS pick
        FROM own o JOIN chunks n ON n.chapter = o.chapter AND (n.chunk_index = o.chunk_index - 1 OR n.chunk_index = o.chunk_index + 1) WHERE o.i = 1 AND o.size < 2),
    both_ AS (SELECT query_id, key, chapter, chunk_index, rank, tokens, 'hit' AS source, NULL::BIGINT AS from_key FROM own
        UNION ALL SELECT query_id, key, chapter, chunk_index, rank, tokens, 'neighbor', from_key FROM wish WHERE pick = 1),
    cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, source) AS n FROM both_ QUALIFY n <= 7),
    held AS (SELECT *, sum(CASE WHEN source = 'hit' THEN tokens ELSE 0 END) OVER (PARTITION BY query_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS held FROM cut QUALIFY held <= 90),
    more AS (SELECT *, sum(CASE WHEN source = 'hit' THEN tokens ELSE 0 END) OVER (PARTITION BY query_id) AS hits_, sum(CASE WHEN source = 'hit' THEN 0 ELSE tokens END) OVER (PARTITION BY query_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS extra FROM held)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY chapter, chunk_index) AS place, key, chapter, chunk_index, source, from_key, rank, tokens FROM more WHERE source = 'hit' OR hits_ + extra <= 90""")
def neighbour_assembly(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    chunks = part.select(F.col("p_partkey").alias("key"), F.floor(F.col("p_partkey") / 10).alias("chapter"), (F.col("p_partkey") % 10).alias("chunk_index"), F.col("p_size").cast("long").alias("tokens"))
    raw = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("key")).agg(F.max("l_extendedprice").alias("p"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), "key"))
    hits = raw.join(chunks, "key").select("query_id", "key", "chapter", "chunk_index", "tokens", rank.alias("rank"), F.lit(True).alias("in_realm"))
    return retrieval.assemble_context(hits, chunks, 4, 2, 7, 90).withColumns({c: F.col(c).cast("long") for c in ("place", "rank")})


@register("""WITH p AS (SELECT o_custkey AS query_id, o_orderkey AS key, c_name AS q, o_orderpriority || o_orderkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS fused_rank FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT query_id, key, fused_rank, ('0x' || left(sha256(q || chr(10) || c), 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS score FROM p WHERE fused_rank <= 32)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM s QUALIFY rank <= 24""")
def reranked_pool(spark, sf_dir):
    own = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    pool = own.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("key"), rank.alias("rank"), F.col("c_name").alias("question"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("content"))
    return models.rerank(pool).withColumns({c: F.col(c).cast("long") for c in ("fused_rank", "rank")})


@register()
def stand_in_vectors(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", models.embed(F.col("text")).alias("embedding"))


@register()
def markdown_blocks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(markup.blocks(F.col("text")))).select("doc_id", F.col("pos").alias("place"), "col.*")


@register("""SELECT event_id, 4 + (event_id % 1200 >= 1000)::INT * -2 AS n_pieces, CASE WHEN event_id % 1200 < 1000 THEN event_id % 1200 END AS first_chapter FROM events""")
def citation_pieces(spark, sf_dir):
    e = F.col("event_id")
    t = F.concat(F.lit("x [C"), (e % 1200).cast("string"), F.lit("] y [c1] [C01] [C7"), F.lit("]"))
    pieces = read(spark, sf_dir, "events").select("event_id", markup.citation_segments(t).alias("s"))
    cited = F.filter("s", lambda p: p["chapter"].isNotNull() & (p["chapter"] != 7))
    return pieces.select("event_id", F.size("s").alias("n_pieces"), F.when(F.col("event_id") % 1200 < 1000, F.coalesce(F.try_element_at(cited["chapter"], F.lit(1)), F.lit(7))).cast("long").alias("first_chapter"))


@register("""SELECT conv_id AS session_id, string_agg('【' || CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END || '】' || coalesce(text, ''), chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id""")
def dialogue_prompts(spark, sf_dir):
    turns = messages(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("t"))
    return turns.select("session_id", markup.dialogue(F.col("t")).alias("dialogue"))


_ANSWERS = """a AS (SELECT source, lang, CASE WHEN toxic = 1 THEN 'generation_failed' WHEN quality = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS status, (n_chars % 3)::INT AS cites, n_chars % 2 = 0 AS in_set, n_chars % 5 = 0 AS expect FROM documents LEFT JOIN labels USING (doc_id))"""


def answers(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    status = F.when(F.col("toxic") == 1, "generation_failed").when(F.col("quality") == 0, "insufficient_evidence").otherwise("answered")
    return d.select(
        "source", "lang", status.alias("status"), (n % 3).cast("int").alias("citation_count"), (n % 2 == 0).alias("citation_in_set"),
        F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("[C1]"))).alias("citation_out_of_range"), (n % 3).cast("long").alias("citation_malformed_count"), (n % 5 == 0).alias("expect_refusal"),
    )


@register(f"""WITH {_ANSWERS}, t AS (SELECT source, count(*) AS questions, count(*) FILTER (status = 'answered') AS answered, count(*) FILTER (status = 'generation_failed') AS failed,
    count(*) FILTER (status = 'answered' AND in_set) AS in_set, count(*) FILTER (status = 'answered' AND cites = 0) AS uncited, (count(*) FILTER (NOT in_set))::BIGINT AS out_of_range, sum(cites)::BIGINT AS malformed,
    count(*) FILTER (expect) AS refusals_expected, count(*) FILTER (expect AND status = 'insufficient_evidence') AS refusals_given, count(*) FILTER (NOT expect AND status = 'insufficient_evidence') AS false_refusals FROM a GROUP BY source)
    SELECT *, CASE WHEN answered = 0 THEN 0 ELSE in_set::DOUBLE / answered END AS in_set_ratio, CASE WHEN refusals_expected = 0 THEN 0 ELSE refusals_given::DOUBLE / refusals_expected END AS refusal_ratio FROM t""")
def answer_breakdown(spark, sf_dir):
    return evaluation.answer_totals(answers(spark, sf_dir), "source")


@register("""WITH v AS (SELECT lang, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'fail' ELSE 'uncertain' END AS v, n_chars FROM documents LEFT JOIN labels USING (doc_id))
    SELECT lang, count(v) AS judged, count(*) - count(v) AS failed, count(*) FILTER (v = 'pass') AS n_pass, count(*) FILTER (v = 'fail') AS n_fail, count(*) FILTER (v = 'uncertain') AS n_uncertain,
    count(*) FILTER (v IS NOT NULL AND n_chars % 2 = 1) AS not_supported, 0::BIGINT AS not_citations_valid, count(*) FILTER (v IS NOT NULL AND n_chars % 3 > 0) AS not_complete, count(v) AS not_refusal_correct FROM v GROUP BY lang""")
def judged_answers(spark, sf_dir):
    d, n = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left"), F.col("n_chars")
    word = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").otherwise("uncertain")
    said = F.struct(word.alias("verdict"), (n % 2 == 0).alias("supported"), F.lit(True).alias("citations_valid"), (n % 3 == 0).alias("complete"), F.lit(False).alias("refusal_correct"), F.array(F.lit("one")).alias("issues"), F.lit("why").alias("reason"))
    raw = F.when(F.col("toxic") == 1, F.concat(F.lit("```"), F.to_json(said))).otherwise(F.to_json(said))
    return evaluation.judge_totals(d.select("lang", R.verdict(raw).alias("v")).select("lang", "v.*"), "lang")


@register("""WITH r AS (SELECT source AS type, CASE WHEN quality = 1 THEN 'matched' WHEN quality = 0 THEN 'low_conf' ELSE 'unmatched' END AS status, CASE WHEN quality = 1 THEN CASE WHEN n_chars % 2 = 0 THEN 'unique_cover' ELSE 'introducer' END END AS tier FROM documents LEFT JOIN labels USING (doc_id))
    SELECT 'status' AS dimension, status AS value, count(*)::DOUBLE AS n FROM r GROUP BY status UNION ALL SELECT 'tier', tier, count(*) FROM r WHERE tier IS NOT NULL GROUP BY tier
    UNION ALL SELECT 'type:status', concat_ws(':', type, status), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'coverage', 'matched', (count(*) FILTER (status = 'matched'))::DOUBLE / count(*) FROM r""")
def mapping_histogram(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "matched").when(F.col("quality") == 0, "low_conf").otherwise("unmatched")
    tier = F.when(F.col("quality") == 1, F.when(F.col("n_chars") % 2 == 0, "unique_cover").otherwise("introducer"))
    return evaluation.mapping_summary(d.select(F.col("source").alias("type"), status.alias("status"), tier.alias("tier")))


@register("""SELECT item_id AS evidence_hash, item_id AS chunk_key, CASE WHEN d.text IS NULL THEN 'chunk' ELSE 'content' END AS reason FROM benchmark b LEFT JOIN documents d ON doc_id = item_id WHERE d.text IS NULL OR NOT contains(d.text, b.text)""")
def stale_mapping_rows(spark, sf_dir):
    b, d = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    own = b.select(F.col("item_id").alias("evidence_hash"), F.col("item_id").alias("chunk_key"))
    return evaluation.stale_mappings(own, b.select(F.col("item_id").alias("evidence_hash"), F.col("text").alias("content")), d.select(F.col("doc_id").alias("chunk_key"), F.col("text").alias("content")))


@register("""WITH u AS (SELECT CAST(ts AS DATE)::VARCHAR AS day, user_id, event_id, event_type FROM events), f AS (SELECT min(event_type) AS first FROM events)
    SELECT day, user_id, count(*) - count(*) FILTER (event_type = first) AS turns FROM u, f GROUP BY day, user_id""")
def refunded_usage(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "user_id", F.col("event_id").alias("request_id"), "event_type")
    first = e.agg(F.min("event_type").alias("first"))  # one row
    usage = store.count_up(spark.createDataFrame([], "day string, user_id long, turns long"), e)
    return store.refund(usage, e.join(F.broadcast(first), F.col("event_type") == F.col("first")))


@register("""WITH s AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, lag(o_orderkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS forked_from FROM orders),
    k AS (SELECT s.* FROM s JOIN customer ON user_id = c_custkey WHERE c_acctbal >= 0), f AS (SELECT k.session_id, k.user_id, o.session_id AS forked_from FROM k LEFT JOIN k o ON k.forked_from = o.session_id)
    SELECT session_id, user_id, forked_from, count(l_orderkey) AS messages FROM f LEFT JOIN lineitem ON session_id = l_orderkey GROUP BY ALL""")
def cascaded_delete(spark, sf_dir):
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    sessions = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), before.alias("forked_from"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    _, kept, left = store.cascade(users, sessions, lines, users.where("c_acctbal < 0"))
    return kept.join(left.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages")), "session_id", "left").na.fill(0, ["messages"])


@register("""WITH old AS (SELECT c_custkey AS k, c_name AS v FROM customer), new AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS v, max(o_orderkey) AS n FROM orders GROUP BY o_custkey)
    SELECT coalesce(new.k, old.k) AS k, coalesce(new.v, old.v) AS v, coalesce(n, 0) AS n FROM old FULL JOIN new ON old.k = new.k""")
def folded_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).cast("long").alias("n"))
    new = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("n"), F.col("o_orderkey").alias("at"))
    return store.upsert_last(old.withColumn("at", F.lit(None).cast("long")), new.withColumn("at", F.col("n")), ["k"], "n").select("k", "v", "n")


EVENT_PROPS = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}


@register("""SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN '$.k: required' WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN '$.k: type' WHEN json_extract(props, '$.k')::BIGINT < 10 THEN '$.k: minimum' ELSE '' END AS problems FROM events""")
def schema_violations(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.array_join(R.schema_problems(F.col("props"), EVENT_PROPS), ",").alias("problems"))
