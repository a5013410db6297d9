"""Registered queries on books, realms, chained retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import catalog, evaluation, retrieval
from ..sources.staging import staged
from .registry import _BM25, _DENSE, _FUSED, _NORM, _ORACLES, context_assembly, questions, read, register

_CH = "ch AS (SELECT source AS book, lang AS volume, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS chapter_index FROM documents)"
_VOL = f"""{_CH}, per AS (SELECT book, volume, count(*) AS chapters, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter FROM ch GROUP BY ALL),
    vol AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY first_chapter)::INT AS volume_index FROM per)"""
_PLAN = rf"""{_VOL}, plan AS (SELECT book, chapter_index, 'book:' || book || ':chapter:' || chapter_index AS chapter_id, volume_index,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')[1] AS title, sha256({_NORM}) AS content_hash FROM ch JOIN vol USING (book, volume))"""


def chapters(spark, sf_dir):
    """documents as chapters: the source is the book, the language the volume."""
    return catalog.numbered_chapters(read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("lang").alias("volume"), "doc_id", "text"))


@register(f"WITH {_VOL} SELECT * FROM vol")
def import_volumes(spark, sf_dir):
    return catalog.import_plan(chapters(spark, sf_dir))[1]


@register(f"WITH {_VOL} SELECT book, sum(chapters)::BIGINT AS chapter_count, count(*) AS volume_count FROM vol GROUP BY book")
def import_books(spark, sf_dir):
    return catalog.import_plan(chapters(spark, sf_dir))[0]


@register(f"WITH {_PLAN} SELECT * FROM plan")
def import_chapters(spark, sf_dir):
    return catalog.import_plan(chapters(spark, sf_dir))[2]


@register(f"WITH {_PLAN} SELECT book, sha256(string_agg(chapter_index || chr(9) || chapter_id || chr(9) || content_hash || chr(10), '' ORDER BY chapter_index)) AS manifest_hash FROM plan GROUP BY book")
def manifest_hashes(spark, sf_dir):
    return catalog.manifest_hashes(catalog.import_plan(chapters(spark, sf_dir))[2])


@register(f"""WITH {_CH}, ends AS (SELECT book, min(chapter_index) AS lo, max(chapter_index) AS hi FROM ch GROUP BY book),
    asked AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE source END AS book, CASE doc_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'past' ELSE CASE WHEN doc_id % 2 = 0 THEN 'past' ELSE 'other' END END AS level, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 300)::INT END AS progress FROM documents),
    e AS (SELECT a.*, lo, hi, CASE WHEN lo IS NULL THEN 'unknown book' WHEN level NOT IN ('full', 'past') THEN 'unknown level' WHEN level = 'past' AND progress IS NULL THEN 'progress is missing' WHEN progress IS NOT NULL AND NOT progress BETWEEN lo AND hi THEN 'progress is out of range' END AS error FROM asked a LEFT JOIN ends USING (book))
    SELECT query_id, book, level, progress, CASE WHEN error IS NULL THEN lo END AS low, CASE WHEN error IS NULL THEN CASE WHEN level = 'full' THEN hi ELSE progress END END AS high, error FROM e""")
def realm_resolution(spark, sf_dir):
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    level = F.when(i % 3 == 0, "full").when((i % 3 == 1) | (i % 2 == 0), "past").otherwise("other")
    asked = d.select(i.alias("query_id"), F.when(i % 11 == 0, "none").otherwise(F.col("source")).alias("book"), level.alias("level"), F.when(i % 4 != 0, (i % 300).cast("int")).alias("progress"))
    return catalog.realms(asked, chapters(spark, sf_dir))


@register(f"""WITH {_CH}, ends AS (SELECT book, min(chapter_index) AS lo, max(chapter_index) AS hi FROM ch WHERE volume = 'en' GROUP BY book),
    l AS (SELECT book, chapter_index, lag(chapter_index) OVER w AS p, lead(chapter_index) OVER w AS n FROM ch WINDOW w AS (PARTITION BY book ORDER BY chapter_index))
    SELECT book, chapter_index, coalesce(chapter_index BETWEEN lo AND hi, false) AS readable, CASE WHEN p BETWEEN lo AND hi THEN p END AS prev, CASE WHEN n BETWEEN lo AND hi THEN n END AS next FROM l LEFT JOIN ends USING (book)""")
def reading_ranges(spark, sf_dir):
    return catalog.reading_range(chapters(spark, sf_dir), "en")


@register(f"""WITH {_CH}, ends AS (SELECT book, min(chapter_index) AS lo, max(chapter_index) AS hi FROM ch WHERE volume = 'en' GROUP BY book)
    SELECT DISTINCT book, unnest(['images/' || (doc_id % 50) || '.png', 'images/' || (doc_id % 7) || '.jpg']) AS image FROM ch JOIN ends USING (book) WHERE chapter_index BETWEEN lo AND hi""")
def readable_images(spark, sf_dir):
    own = chapters(spark, sf_dir)
    name = lambda n, end: F.concat(F.lit("images/"), (F.col("doc_id") % n).cast("string"), F.lit(end))
    return catalog.readable_images(own.withColumn("images", F.array(name(50, ".png"), name(7, ".jpg"))), catalog.reading_range(own, "en"))


@register("SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place, l_partkey::VARCHAR AS p_partkey, p_name, p_size FROM lineitem JOIN part ON p_partkey = l_partkey")
def ordered_lookup(spark, sf_dir):
    keys = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    asked = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(keys.alias("keys"))
    return catalog.lookup_in_order(asked, read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")


@register("SELECT l_orderkey AS query_id, l_suppkey % 4 AS chapter, arg_min('p' || l_partkey, l_linenumber * 10000000 + l_partkey) AS title FROM lineitem GROUP BY ALL")
def context_titles(spark, sf_dir):
    return catalog.context_chapters(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 4).alias("chapter"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("title"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("place")))


@register("""WITH RECURSIVE l AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
    w AS (SELECT conv_id, turn AS head, turn AS here, nxt, 1::BIGINT AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM l AS p WHERE p.conv_id = l.conv_id AND p.nxt = l.turn)
        UNION ALL SELECT l.conv_id, head, l.turn, l.nxt, n + 1 FROM w JOIN l ON l.conv_id = w.conv_id AND l.turn = w.nxt)
    SELECT conv_id * 100000 + head AS head, n AS reached, conv_id * 100000 + here AS last FROM w WHERE nxt IS NULL""")
def chain_walk(spark, sf_dir):
    by = Window.partitionBy("conv_id").orderBy("turn")
    key = lambda turn: F.col("conv_id") * 100_000 + turn
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(by).alias("n"))
    heads = c.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(key(F.col("turn")).alias("key"))
    return catalog.walks(c.select(key(F.col("turn")).alias("key"), key(F.col("n")).alias("next")), heads, lambda df: staged(df, "walk"))


_SCORED, _SIMS = _BM25[: _BM25.rindex("words AS")].rstrip().rstrip(","), _DENSE[: _DENSE.rindex("dense AS")].rstrip().rstrip(",")


@register(f"WITH {_SCORED} SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored WHERE score > 0 AND key IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY rank <= 60")
def keyword_allowed(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return retrieval.bm25(d, questions(spark, sf_dir), "doc_id", "text", allowed=d.where("lang = 'en'").select(F.col("doc_id").alias("key")))


@register(f"""WITH {_BM25}, en AS (SELECT doc_id FROM documents WHERE lang = 'en'),
    past AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored WHERE score > 0 AND key IN (SELECT doc_id FROM en) QUALIFY rank <= 60),
    cut AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM words WHERE key IN (SELECT doc_id FROM en)),
    moved AS (SELECT query_id, key, score, rank - query_id % 2 AS place FROM past WHERE rank > query_id % 2)
    SELECT query_id, count(*) FILTER (NOT coalesce(c.key = m.key AND c.score = m.score, false)) AS breaks FROM cut c LEFT JOIN moved m USING (query_id, place) GROUP BY query_id""")
def realm_prefixes(spark, sf_dir):
    """Rankings inside a realm against the full ones; those of odd questions lack their first row, which breaks them."""
    d = read(spark, sf_dir, "documents")
    inside = d.where("lang = 'en'").select(F.col("doc_id").alias("key"))
    past = retrieval.bm25(d, questions(spark, sf_dir), "doc_id", "text", allowed=inside)
    moved = past.where(F.col("rank") > F.col("query_id") % 2).withColumn("rank", F.col("rank") - F.col("query_id") % 2)
    return evaluation.prefix_breaks(retrieval.bm25(d, questions(spark, sf_dir), "doc_id", "text"), moved, inside)


@register(rf"""WITH {_SCORED}, {_SIMS},
    realm AS (SELECT item_id AS query_id, 0 AS lo, CASE WHEN item_id % 2 = 0 THEN 40 ELSE 1000000000 END AS hi FROM benchmark),
    words AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored JOIN realm USING (query_id) WHERE score > 0 AND key // 4 BETWEEN lo AND hi QUALIFY rank <= 60),
    dense AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sims JOIN realm USING (query_id) WHERE key // 4 BETWEEN lo AND hi QUALIFY rank <= 60), {_FUSED},
    pool AS (SELECT f.query_id, f.key, f.key // 4 AS chapter, least(n_chars, 900) AS tokens, f.rank AS fused_rank,
        ('0x' || left(sha256(trim(regexp_replace(nfc_normalize(b.text), '[\s]+', ' ', 'g')) || chr(10) || d.text), 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS score FROM fused f JOIN benchmark b ON item_id = f.query_id JOIN documents d ON doc_id = f.key WHERE f.rank <= 32),
    second AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM pool QUALIFY rank <= 24),
    held AS (SELECT s.*, key % 4 AS chunk_index, chapter BETWEEN lo AND hi AS inside FROM second s JOIN realm USING (query_id)),
    a AS (SELECT *, min(rank) OVER (PARTITION BY query_id, chapter) AS best FROM held),
    b_ AS (SELECT *, CASE WHEN NOT inside THEN 'realm' WHEN dense_rank() OVER (PARTITION BY query_id ORDER BY best) > 8 THEN 'chapter_cap' END AS r1 FROM a),
    c AS (SELECT *, CASE WHEN r1 IS NULL THEN sum(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, chapter ORDER BY rank, key ROWS UNBOUNDED PRECEDING) END AS i FROM b_),
    d_ AS (SELECT *, CASE WHEN i > 4 THEN 'chapter_chunk_cap' ELSE r1 END AS r2, count(*) FILTER (i <= 4) OVER (PARTITION BY query_id, chapter) AS size FROM c),
    wish AS (SELECT o.query_id, o.chapter, o.rank, o.key AS from_key, n.doc_id AS key, n.doc_id % 4 AS chunk_index, least(n.n_chars, 900) AS tokens, row_number() OVER (PARTITION BY o.query_id, o.key ORDER BY n.doc_id) AS pick
        FROM d_ o JOIN documents n ON n.doc_id // 4 = o.chapter AND (n.doc_id = o.key - 1 OR n.doc_id = o.key + 1)
        WHERE o.i = 1 AND o.size < 4 AND NOT EXISTS (SELECT 1 FROM d_ t WHERE t.query_id = o.query_id AND t.key = n.doc_id AND t.i <= 4)),
    e AS (SELECT query_id, key, chapter, chunk_index, rank, tokens, r2 AS r, 'hit' AS source FROM d_ UNION ALL SELECT query_id, key, chapter, chunk_index, rank, tokens, NULL, 'neighbor' FROM wish WHERE pick = 1),
    f AS (SELECT *, CASE WHEN r IS NULL AND sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank, source, key ROWS UNBOUNDED PRECEDING) > 12 THEN 'top_k_cap' ELSE r END AS r3 FROM e),
    g AS (SELECT *, CASE WHEN r3 IS NULL AND sum(CASE WHEN r3 IS NULL AND source = 'hit' THEN tokens ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank, source, key ROWS UNBOUNDED PRECEDING) > 6000 THEN 'token_budget' ELSE r3 END AS r4 FROM f),
    h AS (SELECT *, CASE WHEN r4 IS NULL AND source = 'neighbor' AND sum(CASE WHEN r4 IS NULL AND source = 'hit' THEN tokens ELSE 0 END) OVER (PARTITION BY query_id)
        + sum(CASE WHEN r4 IS NULL AND source = 'neighbor' THEN tokens ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank, source, key ROWS UNBOUNDED PRECEDING) > 6000 THEN 'token_budget' ELSE r4 END AS reason FROM g),
    done AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY query_id, reason IS NULL ORDER BY chapter, chunk_index) END AS place FROM h),
    none_ AS (SELECT NULL::VARCHAR AS reason, NULL::VARCHAR AS source, NULL::BIGINT AS place)
    SELECT query_id, 'keyword' AS stage, key, rank, score, reason, source, place FROM words, none_ UNION ALL SELECT query_id, 'dense', key, rank, score, reason, source, place FROM dense, none_ UNION ALL SELECT query_id, 'fused', key, rank, score, reason, source, place FROM fused, none_
    UNION ALL SELECT query_id, 'reranked', key, rank, score, reason, source, place FROM second, none_ UNION ALL SELECT query_id, 'assembled', key, rank, NULL, reason, source, place FROM done""")
def retrieval_stages(spark, sf_dir):
    chunks, vectors = chain_tables(spark, sf_dir)
    asked = questions(spark, sf_dir)
    realms = asked.select("query_id", F.lit(0).alias("low"), F.when(F.col("query_id") % 2 == 0, 40).otherwise(1_000_000_000).alias("high"))
    return retrieval.retrieve(chunks, vectors, asked, realms)


def chain_tables(spark, sf_dir):
    """documents as chunks, four a chapter, and their vectors."""
    chapter = lambda key: F.floor(F.col(key) / 4).alias("chapter")
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), chapter("doc_id"), (F.col("doc_id") % 4).alias("chunk_index"), F.col("text").alias("content"), F.least("n_chars", F.lit(900)).alias("tokens"))
    return chunks, read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", chapter("vec_id"))


# Evaluation ---------------------------------------------------------------

_STAGES = """p AS (SELECT l_orderkey AS q, l_partkey AS k, max(l_extendedprice) AS price, bool_or(l_discount < 0.05) AS d, bool_or(l_tax < 0.04) AS w FROM lineitem GROUP BY ALL),
    r AS (SELECT q, k, d, w, row_number() OVER (PARTITION BY q ORDER BY (d OR w) DESC, price DESC, k) AS n0 FROM p),
    s AS (SELECT q, k, d, w, CASE WHEN d OR w THEN n0 END AS n, k % 7 <> 0 AS known FROM r),
    lost AS (SELECT q, o_orderpriority AS type, CASE WHEN known THEN k END AS key, CASE WHEN NOT known THEN 'unmapped' WHEN n <= 2 THEN 'assembled' WHEN n <= 3 THEN 'rerank' WHEN n <= 4 THEN 'fused' WHEN n IS NOT NULL THEN 'fused_truncated' ELSE 'channel_missed' END AS stage FROM s JOIN orders ON o_orderkey = q)"""


def staged_keys(spark, sf_dir):
    """question_id, k, n: parts of an order as candidates; n is the place of those that a channel found."""
    l = read(spark, sf_dir, "lineitem")
    p = l.groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("k")).agg(F.max("l_extendedprice").alias("price"), F.max(F.col("l_discount") < 0.05).alias("d"), F.max(F.col("l_tax") < 0.04).alias("w"))
    n = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.col("d") | F.col("w")), F.desc("price"), "k"))
    return p.withColumn("n0", n).select("question_id", "k", "d", "w", F.when(F.col("d") | F.col("w"), F.col("n0")).alias("n"))


def stage_records(spark, sf_dir):
    of = lambda c, name: F.collect_list(F.when(c, F.col("k"))).alias(name)
    n = F.col("n")
    got = staged_keys(spark, sf_dir).groupBy("question_id").agg(of(F.col("d"), "dense"), of(F.col("w"), "keyword"), of(n <= 4, "fused"), of(n <= 3, "rerank"), of(n <= 2, "assembled"), of(F.col("k") % 7 != 0, "keys"), F.count(F.lit(1)).alias("total"))
    return got.withColumn("hit", F.size(F.filter("assembled", lambda k: k % 7 != 0))).withColumn("mapped", F.size("keys")).withColumn("leak", F.size(F.filter("assembled", lambda k: k % 11 == 0)))


def attributed(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("type"))
    evidence = staged_keys(spark, sf_dir).join(o, "question_id").select("question_id", "type", F.when(F.col("k") % 7 != 0, F.col("k")).alias("key"))
    return evaluation.attribution(evidence, stage_records(spark, sf_dir), recorded=True)


@register(f"WITH {_STAGES} SELECT q AS question_id, type, key, stage FROM lost")
def stage_attribution(spark, sf_dir):
    return attributed(spark, sf_dir)


@register(f"WITH {_STAGES} SELECT type, stage, count(*) AS rows, count(DISTINCT key) AS distinct_keys FROM lost GROUP BY GROUPING SETS ((stage), (type, stage))")
def loss_cross_tab(spark, sf_dir):
    return evaluation.loss_table(attributed(spark, sf_dir))


@register(f"""WITH {_STAGES}, g AS (SELECT q AS question_id, count(*) FILTER (known AND n <= 2) AS hit, count(*) FILTER (known) AS mapped, count(*) AS total, count(*) FILTER (n <= 2 AND k % 11 = 0) AS leak,
        bool_or(known AND coalesce(n, 9) > 3) AS missed, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (known AND coalesce(n, 9) > 2), '') AS lost FROM s GROUP BY q)
    SELECT question_id, CASE WHEN leak > 0 THEN 'leak' WHEN mapped < total THEN 'mapping' WHEN missed THEN 'retrieval' ELSE 'assembly' END AS stage, lost FROM g WHERE hit < total OR leak > 0""")
def failure_rows(spark, sf_dir):
    return evaluation.failures(stage_records(spark, sf_dir)).withColumn("lost", F.array_join(F.col("lost").cast("array<string>"), ","))


@register(f"""WITH {_STAGES} SELECT q AS question_id, count(*) FILTER (known AND n <= 2) AS hit, count(*) FILTER (known) AS mapped, count(*) AS total, count(*) FILTER (n <= 2 AND k % 12 > q % 10) AS leak FROM s GROUP BY q""")
def question_scores(spark, sf_dir):
    s = staged_keys(spark, sf_dir)
    evidence = s.select("question_id", F.when(F.col("k") % 7 != 0, F.col("k")).alias("key"), (F.col("question_id") % 10).alias("progress"))
    return evaluation.question_scores(evidence, s.where("n <= 2").select("question_id", F.col("k").alias("key"), (F.col("k") % 12).alias("chapter")))


@register(f"WITH x AS ({_ORACLES['context_assembly']}) SELECT reason, count(*) AS n, min(query_id) AS first_query FROM x WHERE reason IS NOT NULL GROUP BY reason")
def drop_samples(spark, sf_dir):
    return evaluation.drop_samples(context_assembly(spark, sf_dir))


_Q = "q AS (SELECT doc_id % 900 AS id, source AS type, doc_id % 50 = 0 AS r, doc_id AS file FROM documents)"


@register(f"""WITH {_Q} SELECT 'total' AS rule, count(*) AS value FROM q HAVING count(*) < 5000 UNION ALL SELECT 'refusals', count(*) FILTER (r) FROM q HAVING count(*) FILTER (r) < 300
    UNION ALL SELECT 'type:' || type, count(*) FROM q GROUP BY type HAVING count(*) < 100 UNION ALL SELECT 'duplicate:' || id, count(DISTINCT file) FROM q GROUP BY id HAVING count(DISTINCT file) > 1""")
def dataset_quotas(spark, sf_dir):
    i = F.col("doc_id")
    q = read(spark, sf_dir, "documents").select((i % 900).alias("id"), F.col("source").alias("type"), (i % 50 == 0).alias("expect_refusal"), i.alias("file"))
    return evaluation.quota_errors(q, 5000, 100, 300)


@register("""WITH q AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'past' END AS level, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 200 END AS p, CASE WHEN doc_id % 9 = 0 THEN []::BIGINT[] ELSE [doc_id % 210, doc_id % 190] END AS c, doc_id % 8 = 0 AS r FROM documents)
    SELECT id, array_to_string(list_sort(list_filter([CASE WHEN level = 'past' AND p IS NULL THEN 'past needs progress' END, CASE WHEN level = 'full' AND p IS NOT NULL THEN 'full has no progress' END,
        CASE WHEN len(list_filter(c, lambda x: x < 1 OR x > 193)) > 0 THEN 'chapter is out of range' END, CASE WHEN level = 'past' AND len(list_filter(c, lambda x: x > p)) > 0 THEN 'evidence lies beyond progress' END,
        CASE WHEN r AND len(c) > 0 THEN 'a refusal cites nothing' END, CASE WHEN NOT r AND len(c) = 0 THEN 'an answer needs evidence' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM q""")
def cross_field_errors(spark, sf_dir):
    i = F.col("doc_id")
    cited = F.when(i % 9 == 0, F.array().cast("array<long>")).otherwise(F.array(i % 210, i % 190))
    q = read(spark, sf_dir, "documents").select(i.alias("id"), F.when(i % 2 == 0, "full").otherwise("past").alias("level"), F.when(i % 3 != 0, i % 200).alias("progress"), cited.alias("chapters"), (i % 8 == 0).alias("expect_refusal"))
    return q.select("id", F.array_join(evaluation.cross_field_errors({c: F.col(c) for c in q.columns}, 193), "; ").alias("errors"))


@register("""(SELECT 'first' AS side, c_nationkey AS k FROM customer EXCEPT ALL SELECT 'first', s_nationkey FROM supplier) UNION ALL (SELECT 'second', s_nationkey FROM supplier EXCEPT ALL SELECT 'second', c_nationkey FROM customer)""")
def parity_rows(spark, sf_dir):
    return evaluation.parity(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@register("SELECT a.place, c_custkey, c_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) a JOIN (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS place FROM customer) b USING (place)")
def zipped_rows(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return evaluation.zipped(c.select("c_custkey"), c.select("c_name"), "c_custkey", "c_name")


@register("""WITH r AS (SELECT DISTINCT user_id, nullif(event_type, 'click') AS kind FROM events) SELECT event_id, user_id, nullif(event_type, 'click') AS kind, user_id || ':' || coalesce(nullif(event_type, 'click'), '-') AS outcome FROM events""")
def replayed_outcomes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.nullif(F.col("event_type"), F.lit("click")).alias("kind"))
    recorded = e.select("user_id", "kind").distinct().withColumn("outcome", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.coalesce("kind", F.lit("-"))))
    return evaluation.replay(e, recorded, ["user_id", "kind"])
