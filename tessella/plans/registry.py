"""Registered queries and their DuckDB SQL.

The test tables play these parts: documents are chapters, embeddings are chunk
vectors, conversations are chat messages, events are usage and audit logs,
benchmark items are evidence and questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numbers as N, text as X
from ..operators import chunking, evaluation, mapping, passages, retrieval, sessions
from ..sources.staging import dealt

FLAGSHIP = "hybrid_retrieval"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chat messages: session_id, seq from 1, role, content."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).cast("long").alias("seq"), "role", F.col("text").alias("content"))


# Text ---------------------------------------------------------------------

_NORM = r"regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\f\v]+(\n|$)', '\1', 'g')"


@register(f"SELECT doc_id, sha256({_NORM}) AS content_hash, sha256('book:1:chapter:' || doc_id || chr(10) || {_NORM}) AS evidence_hash FROM documents")
def text_hashes(spark, sf_dir):
    key = F.format_string("book:1:chapter:%d", F.col("doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), X.evidence_hash(key, F.col("text")).alias("evidence_hash"))


@register(r"SELECT item_id, trim(regexp_replace(nfc_normalize(text), '[\s]+', ' ', 'g')) AS question FROM benchmark")
def query_normalisation(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", X.normalize_query(F.col("text")).alias("question"))


@register(r"""SELECT doc_id, floor(0.81::DOUBLE * (length(text) - length(regexp_replace(text, '\p{Han}', '', 'g')))
    + 0.3::DOUBLE * length(regexp_replace(text, '\p{Han}', '', 'g')) + 0.5::DOUBLE)::INT AS token_count FROM documents""")
def token_estimates(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("token_count"))


@register("""SELECT doc_id, len(list_filter(range(1, length(text) + 1), lambda i: substring(text, i::BIGINT, 3) = 'the'))::INT AS places FROM documents""")
def overlapping_occurrences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.count_all(F.col("text"), "the").alias("places"))


@register("""WITH t AS (SELECT event_id, '[C' || (event_id % 1200) || '] x [c' || (event_id % 7) || '] [C0' || (event_id % 9) || ']' AS t FROM events),
    c AS (SELECT event_id, regexp_extract_all(t, '\\[[Cc][0-9][^\\]]*\\]') AS found FROM t)
    SELECT event_id, len(list_filter(found, lambda x: regexp_full_match(x, '\\[C(0|[1-9][0-9]{0,2})\\]')))::INT AS n_citations,
    len(list_filter(found, lambda x: NOT regexp_full_match(x, '\\[C(0|[1-9][0-9]{0,2})\\]')))::INT AS n_violations FROM c""".replace("\\\\", "\\"))
def citation_scan(spark, sf_dir):
    e = F.col("event_id")
    t = F.concat(F.lit("[C"), e % 1200, F.lit("] x [c"), e % 7, F.lit("] [C0"), e % 9, F.lit("]"))
    return read(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", F.size(X.citations(F.col("t"))).alias("n_citations"), F.size(X.violations(F.col("t"))).alias("n_violations"))


@register(r"""WITH f AS (SELECT conv_id AS session_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
    c AS (SELECT session_id, trim(regexp_replace(q, '\s+', ' ', 'g')) AS q FROM f)
    SELECT session_id, CASE WHEN q = '' THEN NULL WHEN length(q) <= 20 THEN q ELSE left(q, 20) || '…' END AS title FROM c""")
def session_titles(spark, sf_dir):
    return sessions.anchors(messages(spark, sf_dir)).where("anchor_seq is not null").select("session_id", X.title(F.col("anchor")).alias("title"))


@register(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS ls, text FROM documents)
    SELECT doc_id, ls[1] AS first_line, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200) AS clamped FROM l""")
def first_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.first_line(F.col("text")).alias("first_line"), X.clamp(F.col("text")).alias("clamped"))


@register("""SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path,
    'req_' || left(sha256(url), 32) AS request_id, CASE WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%#%' THEN 'fragment' ELSE 'plain' END AS kind FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(u, "://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, "://[^/?#]+([^?#]*)", 1).alias("path"),
        F.concat(F.lit("req_"), F.left(F.sha2(u, 256), F.lit(32))).alias("request_id"),
        F.when(F.contains(u, F.lit("?")), "query").when(F.contains(u, F.lit("#")), "fragment").otherwise("plain").alias("kind"),
    )


# Retrieval ----------------------------------------------------------------

_TOKENS = r"regexp_extract_all({t}, '\p{{Han}}|[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}\p{{Z}}]')"
_BM25 = f"""
    asked0 AS (SELECT item_id AS query_id, unnest({_TOKENS.format(t='text')}) AS token FROM benchmark),
    asked AS (SELECT query_id, token, count(*) AS qtf FROM asked0 GROUP BY ALL),
    own AS (SELECT doc_id AS key, {_TOKENS.format(t="coalesce(text, '')")} AS ts FROM documents),
    stats AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM own),
    flat AS (SELECT key, len(ts) AS dl, unnest(ts) AS token FROM own),
    used AS (SELECT key, dl, token, count(*) AS tf FROM flat WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM used GROUP BY token),
    scored AS (SELECT query_id, key, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
        FROM used JOIN df USING (token) JOIN asked USING (token), stats GROUP BY query_id, key),
    words AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 60)"""
_DENSE = """
    qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
    sims AS (SELECT query_id, vec_id AS key, round(list_inner_product(e.embedding::DOUBLE[], q::DOUBLE[])
        / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[]))), 9) AS score FROM embeddings e, qv),
    dense AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sims QUALIFY rank <= 60)"""
_FUSED = """
    both_ AS (SELECT query_id, key, rank, 0 AS channel FROM dense UNION ALL SELECT query_id, key, rank, 1 FROM words),
    grouped AS (SELECT query_id, key, round(coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 0), 0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 1), 0), 12) AS score,
        min(rank) AS best_rank, min(channel * 1000000 + rank) AS seen, list(channel ORDER BY channel) AS sources FROM both_ GROUP BY query_id, key),
    fused AS (SELECT query_id, key, score, best_rank, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, seen, key) AS rank FROM grouped)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as questions, with the vector of the same number."""
    own = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return own.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


@register(f"WITH {_BM25} SELECT query_id, key, score, rank FROM words")
def keyword_top_k(spark, sf_dir):
    return retrieval.bm25(read(spark, sf_dir, "documents"), questions(spark, sf_dir), "doc_id", "text")


@register(f"WITH {_DENSE} SELECT query_id, key, score, rank FROM dense")
def vector_top_k(spark, sf_dir):
    return retrieval.nearest(read(spark, sf_dir, "embeddings"), questions(spark, sf_dir).where("vector is not null"), "vec_id")


@register(f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT query_id, key, score, best_rank, array_to_string(sources, ',') AS sources, rank FROM fused WHERE rank <= 24")
def hybrid_retrieval(spark, sf_dir):
    asked = questions(spark, sf_dir)
    words = retrieval.bm25(read(spark, sf_dir, "documents"), asked, "doc_id", "text")
    dense = retrieval.nearest(read(spark, sf_dir, "embeddings"), asked.where("vector is not null"), "vec_id")
    return retrieval.fuse(dense, words).where(F.col("rank") <= 24).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


@register(f"WITH own AS (SELECT {_TOKENS.format(t='text')} AS ts FROM documents), flat AS (SELECT unnest(list_distinct(ts)) AS token FROM own) SELECT token, count(*) AS df FROM flat GROUP BY token")
def document_frequencies(spark, sf_dir):
    return retrieval.document_frequencies(read(spark, sf_dir, "documents"), "text")


_ORDERS_HITS = "SELECT l_orderkey AS query_id, l_linenumber AS key, l_suppkey % 4 AS chapter, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, l_quantity::BIGINT AS tokens, l_discount < 0.09 AS in_realm FROM lineitem"


@register(f"""WITH h AS ({_ORDERS_HITS}),
    a AS (SELECT *, CASE WHEN NOT in_realm THEN 'realm' END AS r0, min(CASE WHEN in_realm THEN rank END) OVER (PARTITION BY query_id, chapter) AS best FROM h),
    b AS (SELECT *, CASE WHEN r0 IS NULL AND dense_rank() OVER (PARTITION BY query_id ORDER BY best NULLS LAST) > 2 THEN 'chapter_cap' ELSE r0 END AS r1 FROM a),
    c AS (SELECT *, CASE WHEN r1 IS NULL AND sum(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, chapter ORDER BY rank, key ROWS UNBOUNDED PRECEDING) > 2 THEN 'chapter_chunk_cap' ELSE r1 END AS r2 FROM b),
    d AS (SELECT *, CASE WHEN r2 IS NULL AND sum(CASE WHEN r2 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank, key ROWS UNBOUNDED PRECEDING) > 3 THEN 'top_k_cap' ELSE r2 END AS r3 FROM c),
    e AS (SELECT *, CASE WHEN r3 IS NULL AND sum(CASE WHEN r3 IS NULL THEN tokens ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank, key ROWS UNBOUNDED PRECEDING) > 80 THEN 'token_budget' ELSE r3 END AS reason FROM d)
    SELECT query_id, key, chapter, rank, reason IS NULL AS kept, reason FROM e""")
def context_assembly(spark, sf_dir):
    # the SQL leaves lines of one price and number open; here those tied to the end are alike in all columns of the result
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), F.asc_nulls_last("l_linenumber"), "l_suppkey", "l_quantity", "l_discount")
    lines = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"), "l_orderkey")
    hits = lines.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("key"), (F.col("l_suppkey") % 4).alias("chapter"),
        F.row_number().over(order).alias("rank"), F.rint("l_quantity").cast("long").alias("tokens"), (F.col("l_discount") < 0.09).alias("in_realm"),
    )
    return retrieval.assemble(hits, 2, 2, 3, 80, known_best=True)


# Chunks and evidence ------------------------------------------------------


@register()
def chunk_table(spark, sf_dir):
    return chunking.with_keys(chunking.chunks(read(spark, sf_dir, "documents")))


_SPANS = """
    cut AS (SELECT doc_id, unnest(range(0, greatest((length(text) + 299) // 300, 1)))::INT AS chunk_index, text FROM documents),
    ch AS (SELECT doc_id, chunk_index, length(substring(text, greatest(chunk_index * 300 - 50, 0) + 1, CASE WHEN chunk_index = 0 THEN 300 ELSE 350 END)) AS length, CASE WHEN chunk_index = 0 THEN 0 ELSE 50 END AS overlap FROM cut),
    sp AS (SELECT *, (sum(length - overlap) OVER (PARTITION BY doc_id ORDER BY chunk_index))::INT AS "end" FROM ch),
    spans AS (SELECT doc_id, chunk_index, length, overlap, ("end" - length)::INT AS start, "end" FROM sp)"""


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 300 characters that begin 50 before their place."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.greatest(F.floor((F.length("text") + 299) / 300), F.lit(1))
    cut = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk_index"))
    first = F.col("chunk_index") == 0
    content = F.substr("text", F.greatest(F.col("chunk_index") * 300 - 50, F.lit(0)) + 1, F.when(first, 300).otherwise(350))
    return cut.select("doc_id", "chunk_index", F.length(content).alias("length"), F.when(first, 0).otherwise(50).alias("overlap"))


@register(f"WITH {_SPANS} SELECT doc_id, chunk_index, length, overlap, start, \"end\" FROM spans")
def chunk_spans(spark, sf_dir):
    return mapping.spans(fixed_chunks(spark, sf_dir))


_PLACES = f"""{_SPANS},
    own AS (SELECT doc_id, substring(text, (length(text) * (doc_id % 97) // 97)::BIGINT + 1, 40) AS content FROM documents WHERE length(text) > 0),
    ev AS (SELECT doc_id * 2 AS evidence_id, doc_id, content FROM own UNION ALL SELECT doc_id * 2 + 1, doc_id, content || chr(1) FROM own),
    places AS (SELECT evidence_id, doc_id, unnest(list_filter(range(0, length(text) - length(content) + 1), lambda i: substring(text, i::BIGINT + 1, length(content)) = content)) AS s0, length(content) AS n
        FROM ev JOIN documents USING (doc_id))"""


@register(f"""WITH {_PLACES},
    near AS (SELECT evidence_id, chunk_index, spans.start <= s0 AND s0 + n <= "end" AS covers, s0 + n - spans.start > overlap AS new, least(s0 + n, "end") - greatest(s0, spans.start) AS common
        FROM places JOIN spans USING (doc_id) WHERE s0 < "end" AND s0 + n > spans.start),
    per AS (SELECT evidence_id, chunk_index, bool_or(covers) AS covers, bool_or(covers AND new) AS introduces, max(common) AS common FROM near GROUP BY ALL),
    got AS (SELECT evidence_id, count(*) FILTER (covers) AS n, count(*) FILTER (introduces) AS m, min(chunk_index) FILTER (covers) AS lowest, min(chunk_index) FILTER (introduces) AS introducer,
        arg_max(chunk_index, common * 100000 - chunk_index) AS partial, list_sort(list(chunk_index) FILTER (covers)) AS covering FROM per GROUP BY evidence_id)
    SELECT evidence_id, CASE WHEN n > 1 THEN list_filter(covering, lambda c: c <> CASE WHEN m = 1 THEN introducer ELSE lowest END)[1] END AS alternative,
        CASE WHEN n = 1 THEN 'one chunk covers it' WHEN n > 1 AND m = 1 THEN n || ' chunks cover it, one introduces it' WHEN n > 1 THEN n || ' chunks cover it, the first is taken'
            WHEN partial IS NOT NULL THEN 'no chunk covers it, the largest overlap is taken' ELSE 'it stands nowhere' END AS reason, CASE WHEN n > 0 THEN 'matched' WHEN partial IS NOT NULL THEN 'low_conf' ELSE 'unmatched' END AS status,
        CASE WHEN n = 1 THEN lowest WHEN n > 1 AND m = 1 THEN introducer WHEN n > 1 THEN lowest ELSE partial END AS chunk_index,
        CASE WHEN n = 1 THEN 'unique_cover' WHEN n > 1 AND m = 1 THEN 'introducer' WHEN n > 1 THEN 'max_coverage' END AS tier, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence
    FROM ev LEFT JOIN got USING (evidence_id)""")
def evidence_mapping(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return mapping.locate(pieces_as_evidence(docs), docs, mapping.spans(fixed_chunks(spark, sf_dir)))


def pieces_as_evidence(docs: DataFrame) -> DataFrame:
    """evidence_id, doc_id, content: one piece of every document, and one that stands nowhere."""
    at = F.floor(F.length("text") * (F.col("doc_id") % 97) / 97)
    own = docs.where(F.length("text") > 0).select("doc_id", F.substr("text", at.cast("int") + 1, F.lit(40)).alias("content"))
    return own.select((F.col("doc_id") * 2).alias("evidence_id"), "doc_id", "content").unionByName(own.select((F.col("doc_id") * 2 + 1).alias("evidence_id"), "doc_id", F.concat("content", F.lit("\x01")).alias("content")))


@register("""WITH b AS (SELECT DISTINCT substring(text, i::BIGINT, 60) AS w FROM benchmark, LATERAL (SELECT unnest(range(1, length(text) - 58)) AS i) WHERE length(text) >= 60),
    d AS (SELECT doc_id, i, substring(text, i::BIGINT, 60) AS w FROM documents, LATERAL (SELECT unnest(range(1, length(text) - 58)) AS i) WHERE length(text) >= 60)
    SELECT doc_id, min(i) - 1 AS first_offset, count(*) AS windows FROM d SEMI JOIN b USING (w) GROUP BY doc_id""")
def passage_overlap(spark, sf_dir):
    return passages.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# Sessions -----------------------------------------------------------------

_EST = r"floor(0.81::DOUBLE * (length(text) - length(regexp_replace(text, '\p{Han}', '', 'g'))) + 0.3::DOUBLE * length(regexp_replace(text, '\p{Han}', '', 'g')) + 0.5::DOUBLE)::BIGINT"
_TURNS = f"""
    m AS (SELECT conv_id AS session_id, turn + 1 AS seq, role, text, {_EST} AS tokens, CASE WHEN role = 'assistant' AND lag(role) OVER w = 'user' THEN 0 ELSE 1 END AS opens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    turns AS (SELECT *, (sum(opens) OVER (PARTITION BY session_id ORDER BY seq))::BIGINT AS turn FROM m),
    per AS (SELECT session_id, turn, sum(tokens)::BIGINT AS tokens, min(seq) AS first_seq, max(seq) AS last FROM turns GROUP BY session_id, turn)"""


@register(f"WITH {_TURNS} SELECT session_id, seq, role, turn, tokens FROM turns")
def turn_pairs(spark, sf_dir):
    return sessions.turns(messages(spark, sf_dir)).select("session_id", "seq", "role", "turn", "tokens")


@register(f"""WITH {_TURNS} SELECT session_id, turn, tokens, first_seq, (row_number() OVER w <= 2 OR sum(tokens) OVER w <= 300) AS kept FROM per
    WINDOW w AS (PARTITION BY session_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)""")
def history_window(spark, sf_dir):
    return sessions.history(messages(spark, sf_dir), 300)


@register(f"""WITH {_TURNS}, old AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) > 2 AS o FROM per),
    g AS (SELECT session_id, count(*) FILTER (o) AS n_turns, sum(tokens)::BIGINT AS tokens, max(last) FILTER (o) AS upto FROM old GROUP BY session_id) SELECT * FROM g WHERE tokens > 300 AND n_turns > 0""")
def compressible_turns(spark, sf_dir):
    return sessions.compressible(messages(spark, sf_dir), 300, 2)


@register("""WITH p AS (SELECT conv_id AS session_id, coalesce(max(turn + 1) FILTER (role = 'assistant' AND turn + 1 <= 4), 0) AS f FROM conversations GROUP BY conv_id)
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS seq, role, text AS content FROM conversations JOIN p ON conv_id = session_id WHERE turn + 1 <= f""")
def session_forks(spark, sf_dir):
    return sessions.fork(messages(spark, sf_dir), 4)


@register("""WITH new AS (SELECT conv_id AS session_id, turn AS arrival, role, text FROM conversations WHERE role = 'assistant'), last AS (SELECT conv_id AS session_id, max(turn + 1) AS last FROM conversations GROUP BY conv_id)
    SELECT session_id, last + row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS seq, role, text AS content FROM new JOIN last USING (session_id)""")
def sequence_append(spark, sf_dir):
    log = messages(spark, sf_dir)
    new = log.where(F.col("role") == "assistant").withColumnRenamed("seq", "arrival")
    return sessions.append(log, new)


@register("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS turns, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL")
def daily_usage(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("event_type").alias("kinds"))


@register("""SELECT event_id, user_id, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS in_flight FROM events""")
def in_flight_gauge(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.sum(F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)).over(order).cast("long").alias("in_flight"))


@register("""SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_event FROM events GROUP BY user_id""")
def last_row_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    last = evaluation.last_wins(e.withColumn("order", F.col("event_id")), ["user_id"], "order").select("user_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("last_event"))
    return last.join(e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type")), "user_id")


@register("""WITH i AS (SELECT event_id, user_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT i.*, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM i JOIN events USING (event_id, user_id, event_type))
    SELECT user_id, grp::BIGINT AS grp, any_value(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, grp""")
def consecutive_groups(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1))
    return e.withColumn("grp", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).groupBy("user_id", "grp").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


# Aggregations -------------------------------------------------------------


@register("SELECT source, count(*) || ':' || md5(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def fingerprints(spark, sf_dir):
    # the parts are hashes, so a group's list is 80 bytes a row
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "p"))), lambda x: x["p"]), ",")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), joined.alias("j")).select("source", F.concat(F.col("n").cast("string"), F.lit(":"), F.md5("j")).alias("fingerprint"))


_RECORDS = """r AS (SELECT d.source AS type, d.lang AS level, coalesce(l.quality, 0) AS hit, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS mapped, 1 AS total, coalesce(l.toxic, 0) AS leak FROM documents d LEFT JOIN labels l USING (doc_id))"""


def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("source").alias("type"), F.col("lang").alias("level"), F.coalesce("quality", F.lit(0)).cast("long").alias("hit"), F.col("quality").isNotNull().cast("long").alias("mapped"), F.lit(1).cast("long").alias("total"), F.coalesce("toxic", F.lit(0)).cast("long").alias("leak"),
    )


_TOTALS = "count(*) AS questions, sum(hit)::BIGINT AS hits, sum(mapped)::BIGINT AS mapped, sum(total)::BIGINT AS total, sum(leak)::BIGINT AS leaks, sum(hit)::DOUBLE / sum(total) AS recall, sum(mapped)::DOUBLE / sum(total) AS coverage"


@register(f"WITH {_RECORDS} SELECT {_TOTALS} FROM r")
def score_totals(spark, sf_dir):
    return evaluation.totals(score_records(spark, sf_dir))


@register(f"WITH {_RECORDS} SELECT type, {_TOTALS} FROM r GROUP BY type")
def score_breakdown(spark, sf_dir):
    return evaluation.totals(score_records(spark, sf_dir), "type")


@register(f"WITH {_RECORDS} SELECT type, level, count(*) AS n FROM r GROUP BY GROUPING SETS ((), (type), (level))")
def score_grouping_sets(spark, sf_dir):
    r = score_records(spark, sf_dir)
    return r.groupingSets([[], ["type"], ["level"]], "type", "level").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT o_custkey, count(*) FILTER (o_totalprice > 100000) AS large, count(*) FILTER (o_orderstatus = 'O') AS open_, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY o_custkey""")
def overlapping_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderstatus") == "O").alias("open_"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))


@register("WITH c AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey) SELECT min(c) AS low, quantile_disc(c, 0.5) AS middle, max(c) AS high, count(*) AS customers FROM c")
def group_distribution(spark, sf_dir):
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.min("c").alias("low"), F.expr("percentile_disc(0.5) within group (order by c)").cast("long").alias("middle"), F.max("c").alias("high"), F.count(F.lit(1)).alias("customers"))


@register("WITH f AS (SELECT source, min(doc_id) AS first_id FROM documents GROUP BY source) SELECT source, first_id, row_number() OVER (ORDER BY first_id) AS n FROM f")
def first_appearance(spark, sf_dir):
    f = read(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"))
    return f.withColumn("n", F.row_number().over(Window.orderBy("first_id")))


@register(r"""WITH t AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS token FROM documents),
    c AS (SELECT token, source, count(*) AS n FROM t WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY ALL)
    SELECT token, max(n) AS most FROM c GROUP BY token ORDER BY most DESC, token LIMIT 12""")
def concentrated_terms(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).where((F.length("token") >= 2) & ~F.col("token").rlike("^[0-9]+$"))
    return t.groupBy("token", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max("n").alias("most")).orderBy(F.desc("most"), "token").limit(12)


# Joins and sets -----------------------------------------------------------


@register("""SELECT n_nationkey, n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def correlated_counts(spark, sf_dir):
    count = lambda name, key: read(spark, sf_dir, name).groupBy(F.col(key).alias("n_nationkey")).count()
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.join(count("customer", "c_nationkey").withColumnRenamed("count", "customers"), "n_nationkey", "left").join(count("supplier", "s_nationkey").withColumnRenamed("count", "suppliers"), "n_nationkey", "left")
    return n.select("n_nationkey", "n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@register("SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def dangling_rows(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@register("""SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def nearest_keys(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(w).alias("prev_key"), F.lead("o_orderkey").over(w).alias("next_key"))


@register("""WITH a AS (SELECT n_nationkey, count(*) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey), b AS (SELECT n_nationkey, count(*) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey)
    SELECT coalesce(a.n_nationkey, b.n_nationkey) AS k, a.v AS old, b.v AS new FROM a FULL JOIN b USING (n_nationkey) WHERE a.v IS DISTINCT FROM b.v""")
def summary_diff(spark, sf_dir):
    of = lambda name, key: read(spark, sf_dir, name).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return evaluation.difference(of("customer", "c_nationkey"), of("supplier", "s_nationkey"), "k", "v")


@register("""(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)
    UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)""")
def set_operations(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customer")))


@register("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderdate AS DATE) < DATE '1996-01-01' AS expired, strftime(o_orderdate, '%m-%d') AS short FROM orders""")
def date_formats(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.to_date(d).cast("string").alias("day"), (F.to_date(d) < F.lit("1996-01-01").cast("date")).alias("expired"), F.date_format(d, "MM-dd").alias("short"))


@register("""SELECT event_id, json_extract_string(props, '$.' || k) IS NOT NULL AS has_first, len(json_keys(props)) AS n_keys, k AS first_key FROM (SELECT event_id, props, list_sort(json_keys(props))[1] AS k FROM events)""")
def json_keys(spark, sf_dir):
    keys = F.array_sort(F.json_object_keys("props"))
    e = read(spark, sf_dir, "events").select("event_id", "props", keys.alias("ks"))
    first = F.try_element_at("ks", F.lit(1))
    return e.select("event_id", F.from_json("props", "map<string,string>")[first].isNotNull().alias("has_first"), F.size("ks").cast("long").alias("n_keys"), first.alias("first_key"))


from . import books as _books, logs as _logs, records as _records, runs as _runs  # noqa: E402, F401  (register more queries)
