"""Byte-level BPE, fill-in-the-middle and periodic runs against brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessella.llm import byte_bpe, fill_middle, periodic_runs, queries
from tessella.llm.common import words_of

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977} x{i % 13}." for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (4, long), (5, "ab " * 3000), (None, "a null id here here here here here here"), (7, "Ünï çödé\r\n\x0b\x85 x  漢字😀"), (8, "<P>a<S>b"), (9, "x" * 40_000), (10, "<" * 50), (11, "a<S"), (12, "՘꟎₝ x")]
    return spark.createDataFrame([(i, t, 7, 7) for i, t in rows], "doc_id long, text string, n int, runs int")


# Byte-level BPE -----------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = byte_bpe.Ranks(byte_bpe.default_ranks()).rank
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_encoder_is_tiktoken(tiktoken_encoding):
    rng, own = random.Random(1), byte_bpe.RankEncoder(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    bits = ["a", "the", " ", "  ", "\n", " \n", "\t", "'s", "'ll", "1", "!", "é", "漢", "\r\n", "\xa0", "<|endoftext|>", "\x1c", "\x85", "😀", ".", " ", "　", "՘", "₝", "꟎", "ing", "tion", "​", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", None, "a" * 5000, "ab" * 3000, " " * 3000, "漢字" * 900]
    assert [x.tolist() for x in own.encode(texts)] == [tiktoken_encoding.encode_ordinary(t or "") for t in texts]


def greedy(piece, ranks):
    """Merge the leftmost of the lowest pairs until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_merges_are_greedy():
    rng, ranks = random.Random(2), byte_bpe.Ranks(byte_bpe.default_ranks())
    pieces = ["".join(rng.choice("abcdefgh éüя漢") for _ in range(rng.randint(1, 150))).encode() for _ in range(400)] + [b"a", b"aaaaaaaa" * 40, b"\xff\xfe"]
    want = [greedy(p, ranks.rank) for p in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.merge(pieces, ranks)] == want
    for p, w in zip(pieces, want, strict=True):
        if p not in ranks.rank:
            assert byte_bpe.merge_one(p, ranks) == w


def test_ties_go_to_the_leftmost(tmp_path):
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"aa", b"ab", b"aaa"]
    path = tmp_path / "own.ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    ranks = byte_bpe.Ranks(str(path))
    for piece in (b"aaaa", b"aaaaa", b"aab", b"abaab", b"a" * 700):
        assert byte_bpe.merge_one(piece, ranks) == greedy(piece, ranks.rank) == byte_bpe.merge_together([piece], ranks)[0].tolist()
    path.write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        byte_bpe.Ranks(str(path))


def test_late_characters_have_tiktokens_kind(tiktoken_encoding):
    import regex

    rng, pattern = random.Random(3), regex.compile(byte_bpe.default_pattern())
    late = rng.sample(sorted(byte_bpe.late_characters()), 60)
    for c in late:
        text = f"x{c}x 1{c}1"
        assert b"".join(byte_bpe.pieces_of(text, pattern)) == text.encode()
    own = byte_bpe.RankEncoder(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    texts = [f"x{c}x 1{c}1 {c}" for c in late]
    assert [x.tolist() for x in own.encode(texts)] == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_byte_bpe_query(spark, tiktoken_encoding):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(texts[r.doc_id]))


def test_byte_bpe_odd(spark, odd):
    path, pattern = byte_bpe.default_ranks(), byte_bpe.default_pattern()
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(odd, path, pattern), path, pattern).collect()
    want = sorted((str(r.doc_id), (r.text or "").encode()) for r in odd.collect())
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode_documents(odd.limit(0), path, pattern).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode_documents(none, path, pattern).first().decoded) == b""
    with pytest.raises(Exception, match="isn't one of the file's"):
        byte_bpe.decode_documents(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), path, pattern).collect()


# Fill in the middle -------------------------------------------------------


def arranged(doc_id, text):
    """form, prefix, middle, output, step by step."""
    text, key = text or "", digest(f"1:{'' if doc_id is None else doc_id}")
    h = [int(key[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_odd(spark, odd):
    rng = random.Random(4)
    more = spark.createDataFrame([(100 + i, "".join(rng.choice(["<", "P", "S", ">", "M", "é", "😀", "\n", "\r\n", "x"]) for _ in range(rng.randint(0, 30)))) for i in range(400)], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(more)
    texts = sorted(((str(r.doc_id), r.text or "") for r in both.collect()))
    got = fill_middle.restore(fill_middle.arrange(odd.unionByName(more, allowMissingColumns=True))).collect()
    assert sorted((str(r.doc_id), r.restored) for r in got) == texts
    assert sorted((str(r.doc_id), r.n, r.form, r.output) for r in got) == sorted((i, len(t), *(arranged(None if i == "None" else i, t)[k] for k in (0, 3))) for i, t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all((r.prefix_chars is None) == (r.form == "plain") for r in got)
    assert fill_middle.arrange(odd.limit(0)).count() == 0


def test_fill_middle_other_units(spark):
    docs = spark.createDataFrame([(i, f"line {i}\nand more\n\nend {i}") for i in range(60)] + [(99, "x" * 9)], "doc_id long, text string")
    lines = fill_middle.restore(fill_middle.arrange(docs, unit=r"[^\n]*\n|[^\n]+", percent=100)).collect()
    assert all(r.restored == (f"line {r.doc_id}\nand more\n\nend {r.doc_id}" if r.doc_id < 99 else "x" * 9) for r in lines)
    assert {r.n for r in lines} == {4, 1} and all(r.form != "plain" for r in lines)
    assert any(r.output.startswith("<P>line") and "\n<S>" in r.output for r in lines)
    # units that don't cover a text leave it plain
    assert fill_middle.arrange(docs.where("doc_id < 99"), unit=r"[a-z]+", percent=100).where("form <> 'plain'").count() == 0


def test_fill_middle_runs_no_python(spark):
    plan = queries.op12_fill_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Periodic runs ------------------------------------------------------------


def brute_runs(words, least=6, times=4):
    """start, length, period of each run, by comparing all words q apart for every q."""
    number, best = {}, {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    for q in range(1, len(w) // times + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edges[::2], edges[1::2] + q
        for i in np.flatnonzero(end - begin >= max(least, times * q)).tolist():
            best.setdefault((int(begin[i]), int(end[i])), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def by_period(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3), (9, 5)])
def test_runs_are_brute_force(least, times):
    rng, texts = random.Random(5), []
    for _ in range(600):
        k, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 70)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 8)
            w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
        texts.append(w)
    n = np.array([len(w) for w in texts])
    ends = np.cumsum(n)
    some = n >= least
    start, end, period = periodic_runs.find_runs(np.array([x for w in texts for x in w], np.int64), (ends - n)[some], ends[some], least, times)
    want = [(int(e - k) + s, int(e - k) + s + length, q) for w, e, k in zip(texts, ends, n, strict=True) for s, length, q in brute_runs(w, least, times)]
    assert sorted(want) == sorted(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) and len(want) > 100


def test_z_function():
    rng = random.Random(6)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        assert periodic_runs.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, words_of(text)) if doc_id is not None else words_of(text)
    runs = by_period(brute_runs(words))
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (len(runs), *head, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_periodic_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_periodic_runs(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_runs for r in got) > 10
    for r in got:
        assert tuple(r)[1:] == expected(r.doc_id, texts[r.doc_id]), r.doc_id


def test_periodic_odd(spark, odd, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *a: odd)
    got = sorted(((str(r.doc_id), tuple(r)[1:]) for r in queries.op13_periodic_runs(spark, SF).collect()), key=str)
    assert got == sorted(((str(r.doc_id), expected(r.doc_id, r.text)) for r in odd.collect()), key=str)
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, " ".join(["a b"] * 5 + ["c"] * 7)), (2, "a a a a a")], "doc_id long, text string")
    one, two = periodic_runs.periodic_runs(rows).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(0, 10, 2), (10, 7, 1)] and one.collapsed == "a b c" and one.n_words == 17
    assert two.runs == [] and two.collapsed == "a a a a a"
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(rows, times=1)
