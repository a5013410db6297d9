"""Books, volumes, chapters and chunks: import plans, reading ranges, realms, lookups in order, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X


def numbered_chapters(docs: DataFrame, book: str = "book", volume: str = "volume") -> DataFrame:
    """docs (book, volume, doc_id, text) with chapter_index from 1 in each book, by doc_id."""
    order = Window.partitionBy(book).orderBy("doc_id")
    return docs.withColumn("chapter_index", F.row_number().over(order).cast("int"))


def volumes(chapters: DataFrame) -> DataFrame:
    """book, volume, volume_index (from 1, by first chapter), chapters, first_chapter, last_chapter."""
    per = chapters.groupBy("book", "volume").agg(F.count(F.lit(1)).alias("chapters"), F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"))
    return per.withColumn("volume_index", F.row_number().over(Window.partitionBy("book").orderBy("first_chapter")).cast("int"))


def import_plan(chapters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """books, volumes and chapters of a corpus (book, volume, chapter_index, text), as they are imported."""
    vols = volumes(chapters)
    books = vols.groupBy("book").agg(F.sum("chapters").cast("long").alias("chapter_count"), F.count(F.lit(1)).alias("volume_count"))
    key = F.concat(F.lit("book:"), F.col("book"), F.lit(":chapter:"), F.col("chapter_index").cast("string"))
    own = chapters.join(vols.select("book", "volume", "volume_index"), ["book", "volume"])
    rows = own.select("book", "chapter_index", key.alias("chapter_id"), "volume_index", X.first_line(F.col("text")).alias("title"), X.content_hash(F.col("text")).alias("content_hash"))
    return books, vols, rows


def manifest_hashes(chapters: DataFrame) -> DataFrame:
    """book, manifest_hash: hash of a line per chapter (index, tab, id, tab, hash) in order.

    One hash over a sequence needs it in one place: a book's lines, about 100
    bytes a chapter, meet in one task.
    """
    line = F.concat(F.col("chapter_index").cast("string"), F.lit("\t"), F.col("chapter_id"), F.lit("\t"), F.col("content_hash"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("chapter_index", line.alias("line"))))
    return chapters.groupBy("book").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), ""), 256).alias("manifest_hash"))


def realms(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """asked (query_id, book, level, progress) with low, high and error.

    full: all chapters of the book; past: up to progress.  A missing progress
    for past, one outside the book, an unknown level or book is an error and
    never moved into range.
    """
    ends = chapters.groupBy("book").agg(F.min("chapter_index").alias("first"), F.max("chapter_index").alias("last"))
    p = F.col("progress")
    error = (
        F.when(F.col("first").isNull(), "unknown book").when(~F.coalesce(F.col("level").isin("full", "past"), F.lit(False)), "unknown level")
        .when((F.col("level") == "past") & p.isNull(), "progress is missing").when(p.isNotNull() & ~p.between(F.col("first"), F.col("last")), "progress is out of range")
    )
    out = asked.join(ends, "book", "left").withColumn("error", error)
    right = F.col("error").isNull()
    return out.select("query_id", "book", "level", "progress", F.when(right, F.col("first")).alias("low"), F.when(right, F.when(F.col("level") == "full", F.col("last")).otherwise(p)).alias("high"), "error")


def reading_range(chapters: DataFrame, volume: str) -> DataFrame:
    """chapters with readable, prev and next: those from the first to the last chapter of a volume; links out of it are null."""
    ends = chapters.where(F.col("volume") == volume).groupBy("book").agg(F.min("chapter_index").alias("low"), F.max("chapter_index").alias("high"))
    order = Window.partitionBy("book").orderBy("chapter_index")
    linked = chapters.withColumn("prev", F.lag("chapter_index").over(order)).withColumn("next", F.lead("chapter_index").over(order)).join(ends, "book", "left")
    inside = lambda c: F.coalesce(F.col(c).between(F.col("low"), F.col("high")), F.lit(False))
    return linked.select("book", "chapter_index", inside("chapter_index").alias("readable"), F.when(inside("prev"), F.col("prev")).alias("prev"), F.when(inside("next"), F.col("next")).alias("next"))


def readable_images(chapters: DataFrame, readable: DataFrame) -> DataFrame:
    """book, image: distinct images (array column images) of readable chapters."""
    inside = readable.where("readable").select("book", "chapter_index")
    return chapters.join(inside, ["book", "chapter_index"], "left_semi").select("book", F.explode("images").alias("image")).distinct()


def lookup_in_order(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """asked (query_id, keys) with found: the rows of its keys in their order; a missing key ends the job."""
    wanted = asked.select("query_id", F.posexplode("keys").alias("place", key))
    rest = [c for c in rows.columns if c != key]
    known = rows.select(key, F.struct(*rest).alias("row"))
    joined = wanted.join(known, key, "left")
    checked = F.when(F.col("row").isNull(), F.raise_error(F.concat(F.lit("no row of the key "), F.col(key).cast("string"))).cast("string")).otherwise(F.col(key).cast("string"))
    return joined.select("query_id", F.col("place").cast("long").alias("place"), checked.alias(key), *[F.col(f"row.{c}").alias(c) for c in rest])


def context_chapters(context: DataFrame) -> DataFrame:
    """query_id, chapter, title: one row a chapter, with the title of its first chunk."""
    return context.groupBy("query_id", "chapter").agg(F.min_by("title", "place").alias("title"))


def walks(links: DataFrame, heads: DataFrame, stage, rounds: int = 40) -> DataFrame:
    """head, reached, last of the chain from each head (key) along links (key, next; null: the end).

    Pointers are doubled: after round k every key knows the key 2^k steps on,
    so a chain of n links takes log2 n joins.  A chain that runs in a circle or
    to a key that isn't there has no last; stage stores a round's table.
    """
    known = links.select("key").distinct().withColumnRenamed("key", "there")
    now = links.join(known, F.col("next") == F.col("there"), "left").select("key", F.col("next").alias("to"), F.when(F.col("next").isNull(), 1).otherwise(2).cast("long").alias("n"), (F.col("next").isNotNull() & F.col("there").isNull()).alias("lost"))
    now = stage(now.select("key", F.when(~F.col("lost"), F.col("to")).alias("to"), F.when(F.col("lost"), 1).otherwise(F.col("n")).alias("n"), F.when(F.col("to").isNull(), F.col("key")).alias("last"), "lost"))
    for _ in range(rounds):
        if now.where("to is not null").isEmpty():
            break
        ahead = now.select(F.col("key").alias("k"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("last").alias("last2"), F.col("lost").alias("lost2"))
        step = now.join(ahead, F.col("to") == F.col("k"), "left")
        moved = F.col("k").isNotNull()
        now = stage(step.select("key", F.when(moved, F.col("to2")).alias("to"), F.when(moved, F.col("n") + F.col("n2") - 1).otherwise(F.col("n")).cast("long").alias("n"), F.coalesce("last", "last2").alias("last"), (F.col("lost") | F.coalesce("lost2", F.lit(False))).alias("lost")))
        longest = now.agg(F.max("n")).first()[0]
        if longest is not None and longest > 1 << 40:
            break  # a circle
    return heads.join(now, "key").select(F.col("key").alias("head"), F.col("n").alias("reached"), F.when(F.col("to").isNull() & ~F.col("lost"), F.col("last")).alias("last"))


def image_name(path: Column) -> Column:
    """A file's name without folder and ending: its mark in a text."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def corpus_version(raw: Column) -> Column:
    """corpus- and the first 12 hex digits of the hash of the raw index."""
    return F.concat(F.lit("corpus-"), F.left(F.sha2(raw, 256), F.lit(12)))
