import hashlib
import itertools
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.functions import records, segment
from tessella.operators import chunking, retrieval
from tessella.plans import registry
from tessella.sources import corpus, objects, versions

# Words ---------------------------------------------------------------------


def every_cut(run):
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        yield [run[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_lattice_finds_the_best_of_all_cuts():
    rng = random.Random(2)
    for _ in range(60):
        counts = {"".join(rng.choice("红楼梦宝") for _ in range(rng.randint(1, 3))): rng.randint(1, 50) for _ in range(rng.randint(1, 9))}
        lattice, total = segment.Lattice(counts), math.log(sum(counts.values()))
        worth = lambda cut: sum(math.log(counts[w]) - total if w in counts else (-total if len(w) == 1 else -1e9) for w in cut)
        run = "".join(rng.choice("红楼梦宝玉") for _ in range(rng.randint(1, 9)))
        got = lattice.cut(run)
        assert "".join(got) == run and abs(worth(got) - max(map(worth, every_cut(run)))) < 1e-9
    assert segment.Lattice({}).cut("红楼") == ["红", "楼"] and segment.Lattice({"红楼": 1}).cut("") == []


def test_segmenter_in_search_and_frequencies(spark):
    tokenizer = segment.segmenter({"红楼": 9, "红楼梦": 9, "宝玉": 5})
    chunks = spark.createDataFrame([(1, "红楼梦 abc宝玉!x_1"), (2, "宝玉红楼"), (3, None), (4, "")], "key long, content string")
    got = {r["key"]: r.t for r in chunks.select("key", tokenizer(F.col("content")).alias("t")).collect()}
    assert got == {1: ["红楼梦", "abc", "宝玉", "!", "x", "_", "1"], 2: ["宝玉", "红楼"], 3: None, 4: []}
    df = {r.token: r.df for r in retrieval.document_frequencies(chunks, "content", tokenizer).collect()}
    assert df["宝玉"] == 2 and df["红楼梦"] == 1 and "红" not in df
    asked = spark.createDataFrame([(7, "红楼"), (8, "宝玉")], "query_id long, question string")
    found = {(r.query_id, r["key"]) for r in retrieval.bm25(chunks, asked, "key", "content", tokenizer=tokenizer).collect()}
    assert found == {(7, 2), (8, 1), (8, 2)}


def test_dictionaries_have_a_bound(spark, monkeypatch):
    words = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("", 5)], "word string, n long")
    assert segment.dictionary(words) == {"a": 3, "b": 1}
    monkeypatch.setattr(segment, "MAX_WORDS", 1)
    with pytest.raises(ValueError, match="more than"):
        segment.dictionary(words)
    with pytest.raises(ValueError, match="more than"):
        segment.Lattice({"a": 1, "b": 2})


def test_segmented_words_query(spark):
    """The registered query against cutting each text's runs on the driver."""
    import re

    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    runs = [re.findall(r"[a-z]+", t or "") for t in texts]
    counts = {}
    for run in itertools.chain(*runs):
        for k in (2, 3, 4):
            for i in range(max(len(run) - k + 1, 1)):
                if len(run[i : i + k]) > 1:
                    counts[run[i : i + k]] = counts.get(run[i : i + k], 0) + 1
    most = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:500])
    lattice, df = segment.Lattice(most), {}
    for own in runs:
        for w in {w for run in own for w in lattice.cut(run)}:
            df[w] = df.get(w, 0) + 1
    got = {r.token: r.df for r in registry.queries()["segmented_words"](spark, sf).collect()}
    assert {w: n for w, n in got.items() if re.fullmatch("[a-z]+", w)} == df


def test_chunks_by_a_vocabulary(spark):
    import public_tokenizers

    counter = segment.VocabularyCounter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(f"Sentence number {i} says little. " for i in range(400))
    got = chunking.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), count=counter).orderBy("chunk_index").collect()
    assert [r.content for r in got] == chunking.chunk_text(text, counter) and all(r.token_count == counter(r.content) for r in got) and len(got) > 3
    assert max(r.token_count for r in got) <= chunking.TARGET + chunking.OVERLAP


# Objects -------------------------------------------------------------------


def files_of(spark, rows):
    return spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "key string, content binary")


def test_archive_holds_each_content_once_and_names_damage(spark, tmp_path):
    root = str(tmp_path / "archive")
    one = objects.archive(spark, root, files_of(spark, [("a.md", b"same"), ("images/b.png", b"same"), ("c.bin", b""), ("d.JPG", b"other")]))
    assert one.rows("contents") == 3 and one.rows("entries") == 4
    got = {r["key"]: (bytes(r.content), r.bytes, r.media_type) for r in objects.opened(spark, one).collect()}
    assert got == {"a.md": (b"same", 4, "text/markdown"), "images/b.png": (b"same", 4, "image/png"), "c.bin": (b"", 0, "application/octet-stream"), "d.JPG": (b"other", 5, "image/jpeg")}
    two = objects.archive(spark, root, files_of(spark, [("a.md", b"other"), ("e.md", b"new")]))
    assert two.rows("contents") == 4 and objects.verified(spark, two).count() == 0
    assert [bytes(r.content) for r in objects.opened(spark, two, spark.createDataFrame([("a.md",)], "key string")).collect()] == [b"other"]
    assert objects.opened(spark, versions.latest(spark, root, 1)).count() == 4  # the older version is still whole
    # damage one object: its entry is named
    digest = hashlib.sha256(b"new").hexdigest()
    held = two.read(spark, "contents").where(F.col("sha256") == digest).select("shelf", F.input_file_name().alias("f")).first()
    path = held.f.removeprefix("file:").removeprefix("//")
    bad = spark.createDataFrame([(digest, bytearray(b"bad"))], "sha256 string, content binary").toPandas()
    bad.to_parquet(path)
    folder, name = path.rsplit("/", 1)
    Path(folder, f".{name}.crc").unlink()  # else the local file system sees it first
    assert [tuple(r) for r in objects.verified(spark, two).collect()] == [("e.md", "content is damaged")]
    Path(path).unlink()
    assert [tuple(r) for r in objects.verified(spark, two).collect()] == [("e.md", "content is missing")]
    for rows in ([("a", b"1"), ("a", b"2")], [(None, b"1")]):
        with pytest.raises(ValueError, match="no key twice"):
            objects.archive(spark, root, files_of(spark, rows))


def test_scan_gives_logical_keys(spark, tmp_path):
    (tmp_path / "images" / "deep").mkdir(parents=True)
    for name, data in (("images/a.png", b"a"), ("images/deep/b.JPEG", b"bb"), ("images/c.txt", b"c"), ("notes.md", b"n")):
        (tmp_path / name).write_bytes(data)
    rows = {r["key"]: r.bytes for r in objects.scan(spark, str(tmp_path)).collect()}
    assert rows == {"images/a.png": 1, "images/deep/b.JPEG": 2, "images/c.txt": 1, "notes.md": 1}
    assert {r["key"]: r.media_type for r in objects.images(spark, f"file://{tmp_path}").collect()} == {"images/a.png": "image/png", "images/deep/b.JPEG": "image/jpeg"}
    assert {r["key"] for r in objects.scan(spark, str(tmp_path), "*.md").collect()} == {"notes.md"}


def test_book_metadata(spark):
    of = lambda text: spark.createDataFrame([(text,)], "t string").select(objects.book_metadata(F.col("t")).alias("m")).first().m
    assert tuple(of("text\n# 《某书》文库精校版\n\n作者：某人，译者\n")) == ("某书", "某人")
    assert tuple(of("# 某书文库精校版\n作者: 甲 乙")) == ("某书", "甲")
    for bad in ("## 某书\n作者：某人", "# 某书\n没有"):
        with pytest.raises(Exception, match="the description has no"):
            of(bad)


# Parameters ----------------------------------------------------------------

DEFAULTS = {"rrf_k": ("long", 60), "least": ("double", 0.5), "expand": ("boolean", True), "note": ("string", "none")}


def parameters(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"))
    return [tuple(r.p) for r in df.select(records.parameters(F.col("v"), DEFAULTS, 3).alias("p")).collect()]


def test_older_records_get_defaults(spark):
    got = parameters(spark, "{}", '{"schema_version": 3, "rrf_k": 5, "least": 1, "expand": false, "note": "x"}', '{"least": 0.25}')
    assert got == [(60, 0.5, True, "none"), (5, 1.0, False, "x"), (60, 0.25, True, "none")]


@pytest.mark.parametrize(("text", "message"), [
    ('{"schema_version": 4}', "newer"), ('{"rrf_k": 1, "later": 2, "also": 3}', "unknown parameters: also, later"), ('{"rrf_k": "60"}', "another kind: rrf_k"),
    ('{"expand": null}', "another kind: expand"), ('{"rrf_k": 1.5}', "another kind: rrf_k"), ("[1]", "no parameters"),
])
def test_records_that_cannot_be_honoured(spark, text, message):
    with pytest.raises(Exception, match=message):
        parameters(spark, text)


# Hashes --------------------------------------------------------------------


def test_tree_hash_ignores_partitions(spark):
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    one = corpus.tree_hash(rows, "id", 7).first()
    assert one.rows == 1000 and corpus.tree_hash(rows.orderBy(F.desc("id")).repartition(5), "id", 7).first() == one
    lines = [f'{{"id":{i},"v":"v{i}"}}' for i in range(1000)]
    while len(lines) > 1:
        lines = [hashlib.sha256("\n".join(lines[k : k + 7]).encode()).hexdigest() for k in range(0, len(lines), 7)]
    assert one.hash == lines[0]
    assert corpus.tree_hash(rows.where("id <> 5"), "id", 7).first().hash != one.hash
    assert tuple(corpus.tree_hash(rows.limit(0), "id", 7).first()) == (hashlib.sha256(b"").hexdigest(), 0)


def test_segmenter_remembers_within_its_bound(spark, monkeypatch):
    """What a task remembers is bounded inside a batch, too, and words pass into Arrow in slices: results stay."""
    import pyarrow as pa

    texts = pa.array([f"{chr(97 + i % 26)}{i} 红楼梦{i} 宝玉" if i % 7 else (None if i % 2 else "") for i in range(400)])
    counts = {"红楼": 9, "红楼梦": 9, "宝玉": 5}
    want = segment.segmenter(counts).func(texts)
    monkeypatch.setattr(segment, "MEMO", 10)
    monkeypatch.setattr(segment, "WORD_SLICE", 7)
    kept = []
    lattice = segment.Lattice
    monkeypatch.setattr(segment, "Lattice", lambda c: kept.append(lattice(c)) or kept[-1])
    assert segment.segmenter(counts).func(texts).equals(want)
    assert len(kept[0].known) <= 10
    assert want[0].as_py() == [] and want[7].as_py() is None and want[1].as_py() == ["b1", "红楼梦", "1", "宝玉"]
    got = segment.segmenter(counts).func(texts.slice(100, 50))
    assert got.equals(want.slice(100, 50))
