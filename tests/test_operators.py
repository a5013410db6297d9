import itertools
import random
import re

from pyspark.sql import functions as F

from tessella.functions import numbers as N, text as X
from tessella.operators import chunking, evaluation, retrieval, sessions


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_normalize_minimal(spark):
    assert one(spark, "a \r\nb\t　\rc ", X.normalize_minimal) == "a\nb\nc"
    assert one(spark, "  a\n\n b", X.normalize_minimal) == "  a\n\n b"


def test_token_estimate(spark):
    assert one(spark, "汉字abc", X.token_estimate) == 3  # 1.62 + 0.9
    assert one(spark, None, X.token_estimate) == 0


def test_sentences_join_to_the_text(spark):
    rng = random.Random(1)
    for _ in range(30):
        t = "".join(rng.choice(["a", "。", "！", "\n", " ", "”", "b.", "?"]) for _ in range(rng.randint(0, 20)))
        assert "".join(one(spark, t, X.sentences)) == t if t else True


def test_find_all_counts_overlaps(spark):
    assert one(spark, "aaaa", lambda c: X.find_all(c, F.lit("aa"))) == [0, 1, 2]
    assert one(spark, "aaaa", lambda c: X.count_all(c, "aa")) == 3
    assert one(spark, "a", lambda c: X.find_all(c, F.lit("aa"))) == []


def test_overlap_length(spark):
    df = spark.createDataFrame([("abcab", "cabx"), ("abc", "xyz"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(X.overlap_length(F.col("a"), F.col("b"))).collect()] == [3, 0, 0]


def test_citations(spark):
    text = "x [C1] [c2] [C03] [C12][C0] [C1234] [C 1]"
    assert one(spark, text, X.citations) == [1, 12, 0]
    assert one(spark, text, X.violations) == ["[c2]", "[C03]", "[C1234]"]


def test_refusal(spark):
    state = lambda t: one(spark, t, X.refusal_state)
    assert [state(t) for t in ("[INSUFFICIENT] no", "  [INS", "hello", " " * 9, "", "[X")] == ["refusal", "pending", "answer", "answer", "pending", "answer"]


def test_titles_and_lines(spark):
    assert one(spark, "  a \n b ", X.title) == "a b"
    assert one(spark, "x" * 25, X.title) == "x" * 20 + "…"
    assert one(spark, " \t", X.title) is None
    assert one(spark, "\n  b \nc", X.first_line) == "b"
    assert one(spark, "a\x01b", X.clean_log) == "a_b" and one(spark, None, X.clean_log) == "-"


def test_ratio(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(N.ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]
    assert [r[0] for r in df.select(N.show_ratio(F.lit(0.5), F.col("b"))).collect()] == ["0.5000", "—", "?"]


def test_fusion_prefers_both_channels(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "y", 3)], "query_id int, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, key string, rank int")
    got = {r["key"]: (r["rank"], r["score"]) for r in retrieval.fuse(a, b).collect()}
    assert got["y"][0] == 1 and abs(got["y"][1] - (1 / 62 + 1 / 61)) < 1e-9 and got["x"][0] == 2 and got["z"][0] == 3


def test_chunks_keep_order_and_limits():
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice(["词", "语", "。", "\n", "word ", "！"]) for _ in range(rng.randint(0, 3000)))
        made = chunking.chunk_text(text, len)
        assert all(len(c) <= chunking.TARGET for c in made)
        assert all(c in text for c in made)
        at = 0
        for c in made:  # each chunk begins at or before the end of what is covered
            start = max(i for i in range(at + 1) if text.startswith(c, i))
            assert start <= at
            at = max(at, start + len(c))
        assert at == len(text)
    assert chunking.chunk_text("") == []


def test_chunks_by_hand():
    made = lambda t: chunking.chunk_text(t, len, target=10, overlap=4, hard=8)
    assert made("abc。def。") == ["abc。def。"]
    # the overlap is a whole sentence, if the next one fits beside it
    assert made("abcde。xy。efg。") == ["abcde。xy。", "xy。efg。"]
    # it doesn't fit: no overlap
    assert made("abcde。xy。efghijk。") == ["abcde。xy。", "efghijk。"]
    # no whole sentence fits into the overlap: the longest end of the last one
    assert made("abcdefgh。ij。kl。") == ["abcdefgh。", "fgh。ij。kl。"]
    # too long a sentence: pieces of at most 8, each after the overlap, and what follows begins anew
    assert made("ab。" + "x" * 12 + "。cd。") == ["ab。", "ab。" + "x" * 8, "xxxx" + "xxxx。", "xxx。cd。"]
    assert made("x" * 20) == ["x" * 8, "x" * 12, "x" * 8]
    assert chunking.overlap_of("ab。cd。", 3, len) == "cd。" and chunking.overlap_of("abc", 3, len) == "abc" and chunking.overlap_of("abcdef。", 3, len) == "ef。"
    assert chunking.normalised("a \r\nb\t") == "a\nb"


def slow_chunks(text, count, target, overlap, hard):
    """The same by lists of sentences and restarts, written for plainness."""
    units, out, now = re.findall(chunking.SENTENCE, text), [], []

    def before():
        if not out:
            return ""
        c = out[-1]
        if count(c) <= overlap:
            return c
        tails = re.findall(chunking.SENTENCE, c)
        fitting = [tails[i:] for i in range(len(tails)) if sum(map(count, tails[i:])) <= overlap]
        return "".join(fitting[0]) if fitting else next(c[i:] for i in range(len(c) + 1) if count(c[i:]) <= overlap)

    i = 0
    while i < len(units):
        if count(units[i]) > target:
            rest = units[i]
            while rest:
                n = max(k for k in range(1, len(rest) + 1) if count(rest[:k]) <= hard)
                out.append(before() + rest[:n])
                rest = rest[n:]
            i += 1
            continue
        head = before()
        head, room = (head, target - count(head)) if head and count(units[i]) <= target - count(head) else ("", target)
        now = [units[i]]
        i += 1
        while i < len(units) and count(units[i]) <= target and sum(map(count, now)) + count(units[i]) <= room:
            now.append(units[i])
            i += 1
        out.append(head + "".join(now))
    return out


def test_chunks_are_those_of_the_slow_way():
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(["词", "语", "。", "\n", "wd ", "！", "〉", "”", "abcdefgh"]) for _ in range(rng.randint(0, 120)))
        for count, sizes in ((len, (20, 5, 12)), (chunking.estimate, (8, 3, 6))):
            assert chunking.chunk_text(text, count, *sizes) == slow_chunks(text, count, *sizes)


def test_turns_and_history(spark):
    rows = [(1, 1, "system", "a"), (1, 2, "user", "b" * 100), (1, 3, "assistant", "c" * 100), (1, 4, "user", "d"), (1, 5, "user", "e"), (1, 6, "assistant", "f")]
    m = spark.createDataFrame(rows, "session_id int, seq long, role string, content string")
    assert [r["turn"] for r in sessions.turns(m).orderBy("seq").collect()] == [1, 2, 2, 3, 4, 4]
    kept = {r["turn"]: r["kept"] for r in sessions.history(m, 10).collect()}
    assert kept == {1: False, 2: False, 3: True, 4: True}
    assert sessions.fork_points(m, 5).first()["fork_seq"] == 3


def test_rate_limit_counts_accepted_only(spark):
    rng = random.Random(3)
    rows = [(u, i, float(rng.randint(0, 400))) for i, u in enumerate(rng.choice([1, 2, 3]) for _ in range(200))]
    got = {r["event_id"]: r["accepted"] for r in sessions.rate_limited(spark.createDataFrame(rows, "user_id long, event_id long, at double")).collect()}
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[2], r[1])), key=lambda r: r[0]):
        held = []
        for _, i, at in own:
            held = [t for t in held if at - t < 60]
            assert got[i] == (len(held) < 5)
            if len(held) < 5:
                held.append(at)


def test_upsert_and_last_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r.k, r.v) for r in evaluation.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, n int, v string")
    assert evaluation.last_wins(rows, ["k"], "n").first()["v"] == "b"
