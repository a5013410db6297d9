"""Import of books into a versioned store: books, volumes, chapters and chunks change together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources import versions
from ..sources.staging import staged
from . import catalog

TABLES = ("books", "volumes", "chapters", "chunks")


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """chunks (book, chapter_index, chunk_index, chunk_key) with the keys before and after each inside its chapter."""
    order = Window.partitionBy("book", "chapter_index").orderBy("chunk_index")
    return chunks.withColumn("prev_chunk_key", F.lag("chunk_key").over(order)).withColumn("next_chunk_key", F.lead("chunk_key").over(order))


def keyed_chunks(made: DataFrame, chapters: DataFrame) -> DataFrame:
    """made (doc_id, chunk_index, ...) with book, chapter_index and chunk_key of its chapter (book, chapter_index, chapter_id, doc_id); a chunk without chapter ends the job."""
    own = made.join(chapters.select("doc_id", "book", "chapter_index", "chapter_id"), "doc_id", "left")
    key = F.concat(F.col("chapter_id"), F.lit("#c"), F.col("chunk_index").cast("string"))
    checked = F.when(F.col("chapter_id").isNull(), F.raise_error(F.concat(F.lit("no chapter for chunks of "), F.col("doc_id").cast("string"))).cast("string")).otherwise(key)
    return own.withColumn("chunk_key", checked).drop("doc_id", "chapter_id")


def import_books(spark: SparkSession, root: str, docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], base: versions.Snapshot | None = None) -> versions.Snapshot:
    """Replace the books that docs (book, volume, doc_id, text) has, whole, and no others.

    Chapters are numbered by doc_id inside their book.  chunker makes chunks
    (doc_id, chunk_index, ...) of docs; their keys and neighbours are filled in
    here.  Nothing can be read of an import before all four tables are written;
    a book that is imported again with the same texts has the same keys, and
    tables that it no longer has rows in lose their old ones.
    """
    chapters = staged(catalog.numbered_chapters(docs), "chapters")
    if not chapters.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("a doc_id stands for several chapters")
    books, volumes, rows = catalog.import_plan(chapters)
    rows = rows.join(chapters.select("book", "chapter_index", "doc_id", "text"), ["book", "chapter_index"])
    chunks = with_neighbours(keyed_chunks(chunker(chapters), rows))
    base = versions.latest(spark, root) if base is None else base
    names = [r[0] for r in chapters.select("book").distinct().collect()]  # a row of the manifest each
    old = {t: names for t in TABLES if t in base.tables}
    made = dict(zip(TABLES, (books, volumes, rows, chunks), strict=True))
    return versions.commit(spark, root, replace=made, drop=old, by=dict.fromkeys(TABLES, "book"), base=base, note={"books": len(names)})


def import_summary(snapshot: versions.Snapshot) -> dict[str, int]:
    """Rows of each table, from the manifest."""
    return {t: snapshot.rows(t) for t in TABLES}
