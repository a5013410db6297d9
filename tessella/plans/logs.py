"""Registered queries on event streams, throttles, sessions, usage and texts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import markup, numbers as N, text as X
from ..operators import catalog, evaluation, flows, sessions, store
from ..sources import corpus
from .registry import messages, read, register

# Event streams ------------------------------------------------------------

@register("""SELECT conv_id AS request_id, CASE conv_id % 12 WHEN 1 THEN 'event is missing' WHEN 2 THEN 'unknown event' WHEN 3 THEN 'out of order' WHEN 4 THEN 'no end' WHEN 5 THEN 'several ends'
    WHEN 6 THEN 'event after the end' WHEN 8 THEN 'event twice' WHEN 9 THEN 'event is missing' END AS error FROM conversations GROUP BY conv_id""")
def event_order(spark, sf_dir):
    # a whole stream with a delta for each turn, and one fault (or none: 0, 7 ends with an error early, 10 lacks what may be missing, 11) by the conversation's number
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    of = lambda *names: F.array(*[F.lit(x) for x in names])
    fault = F.col("request_id") % 12
    begin = [n for n in flows.ORDER if n not in ("answer_delta", "citation_ready", "query_done", "query_error")]
    without = lambda name: of(*[n for n in begin if n != name])
    head = (
        F.when(fault == 1, without("context_assembled")).when(fault == 2, of("begin", *begin)).when(fault == 3, of(begin[1], begin[0], *begin[2:]))
        .when(fault == 9, without("query_started")).when(fault == 10, without("rewrite_completed")).otherwise(of(*begin))
    )
    tail = (
        F.when(fault == 4, of("citation_ready")).when(fault == 5, of("citation_ready", "query_done", "query_error")).when(fault == 6, of("citation_ready", "query_done", "answer_delta"))
        .when(fault == 7, of("query_error")).when(fault == 8, of("citation_ready", "citation_ready", "query_done")).otherwise(of("citation_ready", "query_done"))
    )
    events = turns.select("request_id", F.posexplode(F.concat(head, F.array_repeat(F.lit("answer_delta"), F.col("n")), tail)).alias("seq", "name"))
    return flows.order_errors(events)


@register(r"""WITH s AS (SELECT conv_id AS request_id, turn, role AS event, regexp_replace(text, '[\r\n]+', ' ', 'g') AS data FROM conversations)
    SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY turn) - 1 AS place, event, data FROM s""")
def stream_frames(spark, sf_dir):
    events = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("role").alias("name"), F.regexp_replace("text", "[\r\n]+", " ").alias("payload"))
    return flows.parse_stream(corpus.frames(events))


@register(r"""WITH g AS (SELECT conv_id AS request_id, string_agg(regexp_replace(text, '[\\"\x00-\x1f]', ' ', 'g'), '' ORDER BY turn) FILTER (role <> 'user') AS t, max(turn) AS n FROM conversations GROUP BY conv_id)
    SELECT request_id, CASE WHEN request_id % 5 < 2 THEN 'generation_failed' ELSE 'answered' END AS status, CASE WHEN request_id % 5 < 2 THEN '' ELSE coalesce(t, '') END AS text FROM g""")
def folded_answers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    text = F.to_json(F.struct(F.regexp_replace("text", r'[\\"\x00-\x1f]', " ").alias("text")))
    own = c.where("role <> 'user'").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.lit("delta").alias("name"), text.alias("payload"))
    ends = c.groupBy(F.col("conv_id").alias("request_id")).agg(F.max("turn").alias("n"))
    kind = F.when(F.col("request_id") % 5 == 0, F.lit(None)).when(F.col("request_id") % 5 == 1, "error").otherwise("done")
    last = ends.select("request_id", (F.col("n") + 1).alias("seq"), F.coalesce(kind, F.lit("delta")).alias("name"), F.when(kind == "done", '{"status":"answered"}').otherwise('{"text":""}').alias("payload"))
    return corpus.fold_events(own.unionByName(last))


# Throttles: what counts depends on what was accepted before ----------------

_SEQ = "e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS tm, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events)"


def timed_events(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return read(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"), (F.col("event_type") == "error").alias("failed"))


@register(f"""WITH RECURSIVE {_SEQ}, r AS (SELECT user_id, event_id, i, [tm] AS held, true AS accepted FROM e WHERE i = 1
        UNION ALL SELECT user_id, event_id, i, CASE WHEN len(f) < 1 THEN list_append(f, tm) ELSE f END, len(f) < 1 FROM (SELECT e.*, list_filter(r.held, lambda t: e.tm - t < 86400.0) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) x)
    SELECT user_id, event_id, accepted FROM r""")
def rate_limit(spark, sf_dir):
    return sessions.rate_limited(timed_events(spark, sf_dir), limit=1, window_s=86_400.0).select("user_id", "event_id", "accepted")


@register(f"""WITH RECURSIVE {_SEQ}, r AS (SELECT user_id, event_id, i, tm AS last, true AS written FROM e WHERE i = 1
        UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.tm - last >= 40000.0 THEN e.tm ELSE last END, e.tm - last >= 40000.0 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, written FROM r""")
def write_throttle(spark, sf_dir):
    visits = timed_events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "at", "event_id")
    return flows.touched(visits, 40_000.0).select(F.col("session_id").alias("user_id"), "event_id", "written")


@register(f"""WITH RECURSIVE {_SEQ}, r AS (SELECT user_id, event_id, i, CASE WHEN failed THEN [tm] ELSE []::DOUBLE[] END AS f, 0.0::DOUBLE AS until, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS state FROM e WHERE i = 1
        UNION ALL SELECT user_id, event_id, i, CASE WHEN locked THEN f0 WHEN NOT failed OR len(f1) >= 3 THEN []::DOUBLE[] ELSE f1 END, CASE WHEN locked THEN until0 WHEN failed AND len(f1) >= 3 THEN tm + 300000.0 ELSE 0.0 END,
            CASE WHEN locked THEN 'locked' WHEN failed THEN 'failed' ELSE 'ok' END
        FROM (SELECT e.user_id, e.event_id, e.i, e.tm, e.failed, r.f AS f0, r.until AS until0, e.tm < r.until AS locked, list_append(list_filter(r.f, lambda t: e.tm - t < 2000000.0), e.tm) AS f1 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) x)
    SELECT user_id, event_id, state FROM r""")
def login_throttle(spark, sf_dir):
    attempts = timed_events(spark, sf_dir).select(F.col("user_id").alias("address"), "at", "failed", "event_id")
    return flows.throttled(attempts, 3, 2_000_000.0, 300_000.0).select(F.col("address").alias("user_id"), "event_id", "state")


@register("""SELECT event_id, greatest(1, ceil(epoch_us(ts) // 1000000 % 60 + 60 - epoch_us(ts) // 1000000 % 97))::BIGINT AS minute, greatest(1, ceil((epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) / 1e6))::BIGINT AS midnight,
    CASE WHEN CAST(ts AS DATE) = DATE '2024-01-01' THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%m-%d') END AS short FROM events""")
def wait_times(spark, sf_dir):
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", flows.minute_wait(s % 60, s % 97).alias("minute"), flows.midnight_wait(ts).alias("midnight"), flows.short_time(ts, F.lit("2024-01-01").cast("date")).alias("short"))


# Sessions -----------------------------------------------------------------


@register("SELECT conv_id AS session_id, turn + 1 AS seq, role, text AS content FROM conversations WHERE conv_id % 3 = 0 OR turn + 1 > conv_id % 4")
def unsummarised_messages(spark, sf_dir):
    own = messages(spark, sf_dir)
    marks = own.where("session_id % 3 <> 0").select("session_id", (F.col("session_id") % 4).alias("upto")).distinct()
    return flows.unsummarised(own, marks)


@register("""WITH m AS (SELECT conv_id AS session_id, conv_id % 4 AS upto, max(turn) + 1 AS last FROM conversations GROUP BY conv_id)
    SELECT session_id, CASE WHEN session_id % 5 < 3 AND session_id % 2 = 0 AND last > upto THEN last ELSE upto END AS upto, CASE WHEN session_id % 5 < 3 AND session_id % 2 = 0 AND last > upto THEN 'new' ELSE 'old' END AS summary FROM m""")
def summary_marks(spark, sf_dir):
    m = messages(spark, sf_dir).groupBy("session_id").agg(F.max("seq").alias("last"))
    made = m.where("session_id % 5 < 3").select("session_id", F.col("last").alias("upto"), F.when(F.col("session_id") % 2 == 0, "new").otherwise("  ").alias("summary"))
    return flows.advance(m.select("session_id", (F.col("session_id") % 4).alias("upto"), F.lit("old").alias("summary")), made)


@register("""WITH a AS (SELECT DISTINCT conv_id + CASE WHEN conv_id % 5 = 0 THEN 1000000 ELSE 0 END AS session_id, conv_id % 7 AS user_id, conv_id FROM conversations)
    SELECT session_id, user_id, CASE WHEN conv_id % 5 = 0 THEN 'not_found' WHEN conv_id % 3 = 0 THEN 'forbidden' ELSE 'ok' END AS state FROM a""")
def session_ownership(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    asked = c.select((F.col("conv_id") + F.when(F.col("conv_id") % 5 == 0, 1_000_000).otherwise(0)).alias("session_id"), (F.col("conv_id") % 7).alias("user_id"))
    held = c.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 7 + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).alias("user_id"))
    return flows.owned(asked, held)


@register("SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_active, row_number() OVER (ORDER BY strftime(max(ts), '%Y-%m-%dT%H:%M:%S') DESC, user_id) AS place FROM events GROUP BY user_id QUALIFY place <= 20")
def recent_users(spark, sf_dir):
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_active"))
    top = last.orderBy(F.desc("last_active"), "user_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_active"), "user_id")))


@register("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 10")
def event_top_ten(spark, sf_dir):
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return read(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(order).alias("place")).where("place <= 10")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return store.page_after(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 50)


_USE = "u AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) || CASE WHEN user_id % 10 = 0 THEN 'x' ELSE '' END AS day, count(*) AS turns FROM events GROUP BY ALL)"


@register(f"WITH {_USE} SELECT day, user_id, turns FROM u WHERE coalesce(try_cast(day AS DATE) >= DATE '2024-01-20' - 10, true)")
def retained_usage(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    day = F.concat(F.to_date("ts").cast("string"), F.when(F.col("user_id") % 10 == 0, "x").otherwise(""))
    used = e.groupBy(day.alias("day"), "user_id").agg(F.count(F.lit(1)).alias("turns"))
    return store.retain(used, F.lit("2024-01-20").cast("date"), 10)


_TIMES = "t AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS tm FROM events)"


@register(f"WITH {_TIMES} SELECT id, tm AS expires_at FROM t WHERE coalesce(try_cast(tm AS TIMESTAMP) > TIMESTAMP '2024-01-15 00:00:00', false)")
def live_logins(spark, sf_dir):
    at = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return store.live_logins(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), at.alias("expires_at")), F.lit("2024-01-15 00:00:00").cast("timestamp"))


@register(f"WITH {_TIMES} SELECT id, tm AS created_at FROM t WHERE coalesce(try_cast(tm AS TIMESTAMP) + INTERVAL 7 DAY > TIMESTAMP '2024-01-15 00:00:00', true)")
def live_accounts(spark, sf_dir):
    at = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return store.live_accounts(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), at.alias("created_at")), F.lit("2024-01-15 00:00:00").cast("timestamp"), 7)


@register("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority LIKE '1%')")
def purged_mappings(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    first = o.withColumn("p", F.left("o_orderpriority", F.lit(1)))
    return store.purge(first, o_orderstatus="F", p="1", o_orderkey=None).drop("p")


@register(f"""SELECT doc_id, CASE WHEN length(text) > 8000 THEN left(text, 8000 - {len(sessions.CUT_MARK)}) || '{sessions.CUT_MARK}' ELSE text END AS content FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def upstream_history(spark, sf_dir):
    return sessions.upstream(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))


# Records ------------------------------------------------------------------


@register("""WITH r AS (SELECT doc_id, doc_id % 7 = 0 AS failed, doc_id % 5 = 0 AS outside, doc_id % 3 = 0 AS expects, doc_id % 2 = 0 AS refused FROM documents)
    SELECT doc_id, CASE WHEN failed THEN 'generation' WHEN outside THEN 'citation' WHEN expects AND NOT refused THEN 'refusal' END AS stage FROM r""")
def answer_failures(spark, sf_dir):
    i = F.col("doc_id")
    record = {"status": F.when(i % 7 == 0, "generation_failed").when(i % 2 == 0, "insufficient_evidence").otherwise("answered"), "citation_out_of_range": F.when(i % 5 == 0, F.array(F.lit("[C1]"))).otherwise(F.array().cast("array<string>")), "expect_refusal": i % 3 == 0}
    return read(spark, sf_dir, "documents").select("doc_id", evaluation.answer_stage(record).alias("stage"))


@register("""SELECT o_orderkey, CASE WHEN k < 0 THEN 0.0 WHEN n = 0 THEN 0.0 WHEN k > n THEN 1.0 ELSE k::DOUBLE / n END::DOUBLE AS progress, (o_orderkey + 9) // 10 AS batches FROM (SELECT o_orderkey, o_orderkey % 13 - 2 AS k, o_custkey % 9 AS n FROM orders)""")
def progress_ratios(spark, sf_dir):
    k, n = F.col("o_orderkey") % 13 - 2, F.col("o_custkey") % 9
    return read(spark, sf_dir, "orders").select("o_orderkey", N.progress(k, n).alias("progress"), N.ceil_div(F.col("o_orderkey"), 10).alias("batches"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, 'chapter_cap:book:1:chapter:' || l_suppkey || '#c' || l_linenumber AS coded, 'chapter_cap' AS reason, 'book:1:chapter:' || l_suppkey || '#c' || l_linenumber AS key, 1 AS book, l_suppkey::INT AS chapter, l_linenumber AS chunk FROM lineitem""")
def reason_keys(spark, sf_dir):
    key = F.format_string("book:1:chapter:%d#c%d", F.col("l_suppkey"), F.col("l_linenumber"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.coded_reason(F.lit("chapter_cap"), key).alias("coded"))
    parts = X.split_reason(F.col("coded"))
    return rows.select("*", parts["reason"].alias("reason"), parts["key"].alias("key")).select("*", X.split_keys(F.col("key")).alias("k")).select("*", "k.*").drop("k")


@register("""SELECT doc_id, '{"status":"answered","chapters":[' || doc_id || ',' || (doc_id + 1) || '],"rewritten":null,"provider":"' || source || '","latency_ms":' || n_chars || '}' AS meta, doc_id + 1 AS last_chapter FROM documents""")
def message_meta(spark, sf_dir):
    i = F.col("doc_id")
    meta = X.message_meta(status=F.lit("answered"), chapters=F.array(i, i + 1), rewritten=F.lit(None).cast("string"), provider=F.col("source"), latency_ms=F.col("n_chars"))
    return read(spark, sf_dir, "documents").select("doc_id", meta.alias("meta")).select("doc_id", "meta", F.element_at(X.meta_chapters(F.col("meta")), -1).alias("last_chapter"))


_T, _C = X.TERMINATORS, X.CLOSERS.replace("'", "''").replace("]", r"\]")


@register(rf"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '[^{_T}\n]*(?:[{_T}]+[{_C}]*(?:[ \t]*\n+)?|\n+)|[^{_T}\n]+') AS s FROM documents)
    SELECT doc_id, len(s) AS sentences, sha256(array_to_string(s, chr(30))) AS bounds, array_to_string(s, '') = text AS whole FROM s""")
def sentence_counts(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", "text", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.sha2(F.array_join("s", "\x1e"), 256).alias("bounds"), (F.array_join("s", "") == F.col("text")).alias("whole"))


@register("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'answer' WHEN event_id % 16 >= 14 THEN 'refusal' ELSE 'pending' END AS state FROM events""")
def refusal_states(spark, sf_dir):
    i = F.col("event_id")
    begin = F.when(i % 3 == 0, "Yes [INSUFFICIENT]").otherwise(F.concat(F.lit("  "), F.substr(F.lit("[INSUFFICIENT] no"), F.lit(1), (i % 16).cast("int"))))
    return read(spark, sf_dir, "events").select("event_id", X.refusal_state(begin).alias("state"))


@register("""SELECT s_suppkey, s_name AS system, 'v' || s_nationkey AS version, left(sha256('<a> ' || s_name || ' </a><b>v' || s_nationkey || '</b>' || chr(0) || 'k'), 12) AS prompt_version FROM supplier""")
def template_sections(spark, sf_dir):
    t = F.concat(F.lit("<a> "), F.col("s_name"), F.lit(" </a><b>v"), F.col("s_nationkey").cast("string"), F.lit("</b>"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", X.section(t, "a").alias("system"), X.section(t, "b").alias("version"), markup.prompt_version(t, F.lit("k")).alias("prompt_version"))


@register("""SELECT p_partkey, list_max(list_filter(range(0, least(length(p_name), length(p_type)) + 1), lambda k: starts_with(p_name || left(p_type, p_partkey % 5), left(p_type, k::BIGINT)) AND right(a, k::BIGINT) = left(p_type, k::BIGINT) OR k = 0))::INT AS overlap
    FROM (SELECT *, p_name || left(p_type, p_partkey % 5) AS a FROM part)""".replace("starts_with(p_name || left(p_type, p_partkey % 5), left(p_type, k::BIGINT)) AND ", ""))
def overlap_lengths(spark, sf_dir):
    before = F.concat("p_name", F.left("p_type", (F.col("p_partkey") % 5).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", X.overlap_length(before, F.col("p_type")).alias("overlap"))


@register("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'images/a' || p_partkey || '.png' WHEN p_partkey % 4 = 1 THEN 'images/b.jpg' END AS key, 'a' || p_partkey AS mark FROM part""")
def image_keys(spark, sf_dir):
    i = F.col("p_partkey")
    path = F.when(i % 4 == 0, F.concat(F.lit("images/./x/../a"), i.cast("string"), F.lit(".png"))).when(i % 4 == 1, "images/b.jpg").when(i % 4 == 2, "images/../secret.png").otherwise("/images/c.png")
    return read(spark, sf_dir, "part").select("p_partkey", markup.image_key(path).alias("key"), catalog.image_name(F.concat(F.lit("images/a"), i.cast("string"), F.lit(".png"))).alias("mark"))


@register("SELECT doc_id, 'corpus-' || left(sha256(text), 12) AS version FROM documents")
def corpus_versions(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", catalog.corpus_version(F.encode("text", "UTF-8")).alias("version"))
