import json
import threading

import pytest
from pyspark.sql import functions as F

from tessella.operators import chunking, importing
from tessella.sources import corpus, versions

ROWS = "i int, v string, book string"


def test_parts_are_replaced_and_the_rest_carried_over(spark, tmp_path):
    root = str(tmp_path / "store")
    one = versions.commit(spark, root, replace={"t": spark.createDataFrame([(1, "a", "x"), (2, "b", "y z/%"), (3, "c", None)], ROWS), "u": spark.range(3).toDF("n")}, by={"t": "book"})
    two = versions.commit(spark, root, replace={"t": spark.createDataFrame([(9, "q", "y z/%")], ROWS)}, by={"t": "book"})
    assert sorted(map(tuple, two.read(spark, "t").select("i", "v", "book").collect()), key=str) == [(1, "a", "x"), (3, "c", None), (9, "q", "y z/%")]
    three = versions.commit(spark, root, append={"u": spark.range(5).toDF("n")}, drop={"t": [None, "x"]})
    assert three.rows("u") == three.read(spark, "u").count() == 8 and [r.i for r in three.read(spark, "t").collect()] == [9]
    # older versions stay readable
    assert one.read(spark, "t").count() == 3 and versions.latest(spark, root, 1).rows("u") == 3
    assert versions.verify(spark, versions.latest(spark, root)) == [] and versions.latest(spark, root).version == 3
    with pytest.raises(ValueError, match="no version"):
        versions.latest(spark, root, 7)
    with pytest.raises(ValueError, match="other columns"):
        versions.commit(spark, root, append={"u": spark.range(1).select(F.col("id").cast("string").alias("n"))})
    assert versions.commit(spark, root, drop={"t": []}).tables.keys() == {"u"}


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    root = str(tmp_path / "store")
    base = versions.commit(spark, root, replace={"t": spark.range(1).toDF("n")})
    versions.commit(spark, root, replace={"t": spark.range(2).toDF("n")}, base=base)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, replace={"t": spark.range(3).toDF("n")}, base=base)
    assert versions.latest(spark, root).rows("t") == 2


@pytest.mark.parametrize("publish", ["_link", "_rename"])
def test_put_if_absent_has_one_winner(spark, tmp_path, monkeypatch, publish):
    monkeypatch.setattr(versions, "_link", getattr(versions, publish))
    path, won = str(tmp_path / "c" / "1.json"), []
    if publish == "_link":  # a rename on the local file system checks and renames in two steps
        threads = [threading.Thread(target=lambda i=i: won.append((versions.put_if_absent(spark, path, str(i)), i))) for i in range(8)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    else:
        won = [(versions.put_if_absent(spark, path, str(i)), i) for i in range(3)]
    winners = [i for ok, i in won if ok]
    assert len(winners) == 1 and (tmp_path / "c" / "1.json").read_text() == str(winners[0])
    assert [p.name for p in (tmp_path / "c").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_a_job_that_dies_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "store")
    versions.commit(spark, root, replace={"a": spark.range(4).toDF("n"), "b": spark.range(4).toDF("n")})
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception, match="broken"):
        versions.commit(spark, root, replace={"a": spark.range(9).toDF("n"), "b": broken})
    now = versions.latest(spark, root)
    assert now.version == 1 and now.read(spark, "a").count() == 4 and now.read(spark, "b").count() == 4
    # what the dead job wrote is swept once it is old enough, what is used isn't
    assert versions.sweep(spark, root) == []
    assert len(versions.sweep(spark, root, older_s=-60)) >= 1 and versions.verify(spark, now) == []
    versions.commit(spark, root, replace={"a": spark.range(1).toDF("n")})
    versions.sweep(spark, root, keep=1, older_s=-60)
    assert versions.latest(spark, root).rows("a") == 1 and versions.verify(spark, versions.latest(spark, root)) == []


def test_damage_is_named(spark, tmp_path):
    root = str(tmp_path / "store")
    got = versions.commit(spark, root, replace={"a": spark.range(4).repartition(2).toDF("n"), "b": spark.range(4).toDF("n")})
    next((tmp_path / "store" / got.tables["a"]["entries"][0]["folder"]).glob("part-*.parquet")).unlink()
    assert versions.verify(spark, got) == ["a"]


DOCS = "book string, volume string, doc_id long, text string"


def test_import_is_repeatable_and_fills_neighbours(spark, tmp_path):
    text = lambda k: "".join(f"This is sentence {i} of text {k}, which goes on for a while. " for i in range(150))
    docs = spark.createDataFrame([("a", "v1", 1, text(1)), ("a", "v2", 2, text(2)), ("b", "v1", 3, text(3)), ("b", "v1", 4, "")], DOCS)
    root = str(tmp_path / "books")
    one = importing.import_books(spark, root, docs, chunking.chunks)
    first = {r.chunk_key: r for r in one.read(spark, "chunks").collect()}
    assert importing.import_summary(one) == {"books": 2, "volumes": 3, "chapters": 4, "chunks": len(first)} and len(first) > 6
    for r in first.values():
        inside = sorted((x for x in first.values() if (x.book, x.chapter_index) == (r.book, r.chapter_index)), key=lambda x: x.chunk_index)
        at = [x.chunk_key for x in inside].index(r.chunk_key)
        assert r.prev_chunk_key == (inside[at - 1].chunk_key if at else None)
        assert r.next_chunk_key == (inside[at + 1].chunk_key if at + 1 < len(inside) else None)
    # the same import gives the same keys; another book isn't touched
    two = importing.import_books(spark, root, docs.where("book = 'b'"), chunking.chunks)
    assert {r.chunk_key: r for r in two.read(spark, "chunks").select(*one.read(spark, "chunks").columns).collect()} == first
    folders = lambda s: {(e["part"], e["folder"]) for e in s.tables["chunks"]["entries"]}
    assert {f for f in folders(two) if f[0] == "book=a"} == {f for f in folders(one) if f[0] == "book=a"}
    # a book without chunks loses its old ones
    three = importing.import_books(spark, root, docs.where("doc_id = 4"), chunking.chunks)
    assert {r.book for r in three.read(spark, "chunks").select("book").distinct().collect()} == {"a"}
    assert three.read(spark, "chapters").where("book = 'b'").count() == 1


def test_import_that_fails_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("a", "v", 1, "One sentence. Another one.")], DOCS)
    root = str(tmp_path / "books")
    one = importing.import_books(spark, root, docs, chunking.chunks)
    stray = lambda chapters: chunking.chunks(chapters.withColumn("doc_id", F.col("doc_id") + 7))
    with pytest.raises(Exception, match="no chapter"):
        importing.import_books(spark, root, docs, stray)
    with pytest.raises(ValueError, match="several chapters"):
        importing.import_books(spark, root, docs.unionByName(docs), chunking.chunks)
    assert versions.latest(spark, root).version == one.version == 1


def test_run_folder_is_one_version(spark, tmp_path):
    path = str(tmp_path / "run")
    records = spark.createDataFrame([("q1", 1), ("q2", 0)], "question_id string, hit int")
    report = spark.createDataFrame([(1, "| b |"), (0, "| a |")], "place int, line string")
    got = corpus.write_run(path, records, records.where("hit = 0"), records.limit(1), {"run_id": "r", "k": 60}, report)
    assert got.note == {"run_id": "r", "k": 60} and [r.value for r in got.read(spark, "report").collect()] == ["| a |", "| b |"]
    assert {tuple(r) for r in corpus.read_run(spark, path, "records", "question_id string, hit int").collect()} == {("q1", 1), ("q2", 0)}
    assert corpus.read_run(spark, path, "failures", "question_id string, hit int").count() == 1
    files = list((tmp_path / "run" / got.tables["records"]["entries"][0]["folder"]).glob("part-*"))
    assert all(json.loads(line) for f in files for line in f.read_text().splitlines())


def test_places_of_a_wide_table(spark):
    """Counts and rows come from one stored table, so places have no gaps even where ranges are sampled and merged anew."""
    n = 1_200_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("place_"))
    got = corpus.placed(rows, "k").agg(F.count_distinct("place").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")).first()
    assert (got.n, got.low, got.high) == (n, 0, n - 1)
    small = corpus.placed(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, at string"), "k", "nth")
    assert sorted(map(tuple, small.collect())) == [(1, "a", 0), (2, "b", 1), (3, "c", 2)]
    assert corpus.placed(small.limit(0).drop("nth"), "k").count() == 0
