"""Scans and sinks of corpora and record files, with declared schemas.

Nothing is inferred: a line that doesn't fit its schema ends the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import content_hash, normalize_minimal
from . import versions
from .staging import staged

CORPUS = "id string, vol string, title string, url string, images array<string>, text string"
QUESTION = (
    "schema_version string, id string, type string, book_id int, question string, reference_points array<string>, reference_answer string, level string, progress int, "
    "expect_refusal boolean, must_cite_groups array<array<struct<chapter_id: string, content: string>>>"
)


def read_corpus(spark: SparkSession, path: str, book: int = 1) -> DataFrame:
    """Chapters of a JSON-lines file; the line number, from 1, is the chapter's index.

    Lines keep their order by their byte place in the file: each task numbers
    its lines, and a task's first number follows from the counts before it.  A
    blank line is an error, as are one that isn't a record and one that lacks a
    field or has no text.
    """
    lines = spark.read.text(path)
    placed = lines.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"))
    before = counts.select("p", "low", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a task
    order = Window.partitionBy("p").orderBy("__at")
    numbered = placed.withColumn("p", part).join(F.broadcast(before), "p").withColumn("chapter_index", (F.col("before") + F.row_number().over(order)).cast("int"))
    value = F.when(F.trim("value") == "", F.raise_error(F.format_string("line %d is blank", "chapter_index")).cast("string")).otherwise(F.col("value"))
    numbered = numbered.withColumn("value", value)
    parsed = numbered.select("chapter_index", F.from_json("value", CORPUS, {"mode": "FAILFAST"}).alias("r")).select("chapter_index", "r.*")
    missing = [c for c in ("id", "vol", "title", "url", "images", "text")]
    bad = F.greatest(*[F.col(c).isNull().cast("int") for c in missing]) == 1
    empty = F.trim("text") == ""
    checked = F.when(bad | empty, F.raise_error(F.format_string("line %d lacks a field or has no text", "chapter_index")).cast("string")).otherwise(normalize_minimal(F.col("text")))
    out = parsed.withColumn("text", checked)
    return out.withColumn("chapter_id", F.format_string("book:%d:chapter:%d", F.lit(book), F.col("chapter_index"))).withColumn("content_hash", content_hash(F.col("text")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per question, with its file name; schema.json and example.json aren't questions, and a folder without any is an error."""
    rows = spark.read.schema(QUESTION).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("file not in ('schema.json', 'example.json')")
    if rows.select("file").isEmpty():
        raise ValueError(f"{path} has no questions")
    broken = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.col("file"), F.lit(" isn't a question"))).cast("string")).otherwise(F.col("id"))
    return rows.withColumn("id", broken)


def evidence(questions: DataFrame) -> DataFrame:
    """question_id, ordinal from 0, chapter_id, content of the flattened evidence groups."""
    flat = questions.select(F.col("id").alias("question_id"), F.posexplode(F.flatten("must_cite_groups")).alias("ordinal", "e"))
    return flat.select("question_id", "ordinal", "e.chapter_id", "e.content")


def guarded(rows: DataFrame, most: int = 500) -> DataFrame:
    """rows; a string beyond most characters, at any depth, ends the job."""

    def check(column: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(F.length(column) > most, F.raise_error(F.lit(f"{name} is too long")).cast("string")).otherwise(column)
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: check(x, kind.elementType, name))
        if isinstance(kind, T.StructType):
            return F.when(column.isNotNull(), F.struct(*[check(column[f.name], f.dataType, f"{name}.{f.name}").alias(f.name) for f in kind.fields]))
        return column

    return rows.select(*[check(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in rows.schema.fields])


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys and explicit nulls, refusing strings beyond 500 characters at any depth."""
    canonical_lines(guarded(rows)).write.text(path)


#: How events that end a stream are called, and an error on the wire.
DONE_EVENTS, ERROR_EVENTS, WIRE_ERROR = ("done", "query_done"), ("error", "query_error"), "error"


def frames(events: DataFrame) -> DataFrame:
    """events (request_id, seq, name, payload) as one event-stream text per request.

    The end is followed by [DONE], an error isn't; nothing follows either.
    """
    ends = lambda e: e["name"].isin(*DONE_EVENTS, *ERROR_EVENTS)
    name = lambda e: F.when(e["name"].isin(*ERROR_EVENTS), WIRE_ERROR).otherwise(e["name"])
    one = lambda e: F.concat(F.lit("event: "), name(e), F.lit("\ndata: "), e["payload"], F.lit("\n\n"), F.when(e["name"].isin(*DONE_EVENTS), F.lit("data: [DONE]\n\n")).otherwise(F.lit("")))
    ordered = events.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "payload"))).alias("es"))
    stop = F.array_position(F.transform("es", ends), F.lit(True)).cast("int")
    sent = F.when(stop > 0, F.slice("es", F.lit(1), stop)).otherwise(F.col("es"))
    return ordered.select("request_id", F.array_join(F.transform(sent, one), "").alias("stream"))


def fold_events(events: DataFrame) -> DataFrame:
    """request_id, status, text: deltas joined in order; an error clears the text, no end is a failure."""
    delta = F.get_json_object("payload", "$.text")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "name", delta.alias("text"), F.get_json_object("payload", "$.status").alias("status"))))
    got = events.groupBy("request_id").agg(ordered.alias("es"))
    error = F.exists("es", lambda e: e["name"] == "error")
    done = F.element_at(F.filter("es", lambda e: e["name"] == "done"), 1)
    text = F.array_join(F.transform(F.filter("es", lambda e: e["name"] == "delta"), lambda e: e["text"]), "")
    failed = error | ~F.exists("es", lambda e: e["name"] == "done")
    return got.select("request_id", F.when(failed, "generation_failed").otherwise(done["status"]).alias("status"), F.when(failed, "").otherwise(text).alias("text"))


def placed(rows: DataFrame, order: str, place: str = "place") -> DataFrame:
    """rows with place, from 0, in the order of a column: ranges are sorted by themselves and counted, so no task gets all rows.

    Ranges are sampled, so the ranged rows are stored once, numbered within
    their range; counts and rows come from the same table.
    """
    at, part, before = ("__" + "_" * max(map(len, rows.columns)) + x for x in ("at", "part", "before"))
    ranged = staged(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    own = ranged.withColumn(part, F.shiftright(at, 33))
    counts = own.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))  # one row a range
    value = (F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return own.join(F.broadcast(starts), part).withColumn(place, value).select(*rows.columns, place)


def canonical_lines(rows: DataFrame) -> DataFrame:
    """value: each row as compact JSON with sorted keys and explicit nulls, nested ones too."""

    def sorted_(column, kind):
        if isinstance(kind, T.StructType):
            made = F.struct(*[sorted_(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
            return F.when(column.isNotNull(), made)
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: sorted_(x, kind.elementType))
        return column

    parts = [sorted_(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)]
    return rows.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value"))


def dataset_hash(rows: DataFrame, by: str = "id") -> str:
    """Hash of the canonical lines in the order of a column, joined by LF.

    One hash over a sequence has to see it in order: one task sorts the lines,
    spilling where they are many, and hashes them as batches go by; the driver
    gets the hash.  ``tree_hash`` is the form for large tables.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        total, first = hashlib.sha256(), True
        for batch in batches:
            for line in batch.column(1).to_pylist():
                total.update((("" if first else "\n") + line).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()])], names=["hash"])

    return keyed_lines(rows, by).repartition(1).sortWithinPartitions("by", "value").mapInArrow(run, "hash string").first()["hash"]


def keyed_lines(rows: DataFrame, by: str) -> DataFrame:
    """by, value: each row's canonical line beside a column of it."""
    return canonical_lines(rows).select(F.get_json_object("value", f"$['{by}']").cast(rows.schema[by].dataType).alias("by"), "value")


def tree_hash(rows: DataFrame, by: str = "id", block: int = 4096) -> DataFrame:
    """hash, rows: one row for a table, hashed in blocks of the canonical lines in order, then in blocks of those hashes, until one is left.

    A task holds a block, never the table.  Equal tables have equal hashes
    whatever their partitions; rows that are equal in by are put in order by
    their lines.  Of a table without rows the hash is that of nothing.
    """
    lines = keyed_lines(rows, by).select(F.lit(0).alias("g"), "by", F.col("value").alias("line"))
    got = grouped_tree(lines, block)
    none = F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256))
    return got.agg(none.alias("hash"), F.coalesce(F.max("rows"), F.lit(0)).cast("long").alias("rows"))


def grouped_tree(lines: DataFrame, block: int = 4096, levels: int | None = None) -> DataFrame:
    """g, hash, rows: the tree hash of each group's lines (g, by, line), in the order of by and line.

    Lines are numbered over all groups at once, so a group of any size is split
    into ranges, and a task holds a block of one group.  Null groups are one.
    Null lines take a place and add nothing; of null lines only, the hash is
    null.  With levels the tree ends after so many: a group that still has
    several blocks there has a row for each.
    """
    numbered = placed(lines.select(F.struct("g", "by", "line").alias("key")), "key").select("key.g", "place", "key.line")
    first = staged(numbered.groupBy("g").agg(F.min("place").alias("first")), "groups")
    same = numbered["g"].eqNullSafe(first["g"])
    level = numbered.join(first, same).select(numbered["g"], (F.col("place") - F.col("first")).alias("place"), "line", F.lit(1).cast("long").alias("rows"))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    hashed = F.when(F.count("line") > 0, F.sha2(part, 256))
    done = 0
    while True:
        level = staged(level.groupBy("g", F.floor(F.col("place") / block).alias("place")).agg(hashed.alias("line"), F.sum("rows").alias("rows")), "hashes")
        done += 1
        if done == levels or level.where("place > 0").isEmpty():
            return level.select("g", F.col("line").alias("hash"), "rows")


# The fields of a retrieval record that a run writes, and what a generation's status may be.
RETRIEVAL_RECORD = "question_id string, type string, level string, hit int, mapped int, total int, leak int, keys array<string>, dense array<string>, keyword array<string>, fused array<string>, rerank array<string>, assembled array<string>, dropped array<string>"
STATUSES = ("answered", "insufficient_evidence", "generation_failed")
RETIRED = ("difficulty",)


def read_records(spark: SparkSession, path: str, schema: str = RETRIEVAL_RECORD) -> DataFrame:
    """Score records of a JSON-lines file.

    Fields that the schema doesn't know end the job (a retired one is dropped),
    as do values of another type, a status that isn't one, and an empty file.
    """
    lines = spark.read.text(path)
    if lines.isEmpty():
        raise ValueError(f"{path} has no records")
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    unknown = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(n) for n in (*names, *RETIRED)]))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown field "), F.array_join(unknown, ", "))).cast("string")).otherwise(F.col("value"))
    out = lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if "status" in names:
        out = out.withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.lit("unknown status")).cast("string")))
    return out


def read_mapping_lookup(spark: SparkSession, path: str) -> DataFrame:
    """evidence_hash, chunk_key of a mapping run; rows that aren't matched stay, without key."""
    rows = spark.read.schema("evidence_hash string, chunk_key string, status string").option("mode", "FAILFAST").json(path)
    return rows.select("evidence_hash", F.when(F.col("status") == "matched", F.col("chunk_key")).alias("chunk_key"))


def write_run(path: str, records: DataFrame, failures: DataFrame, summary: DataFrame, config: dict | None = None, report: DataFrame | None = None) -> versions.Snapshot:
    """A run's artifacts as one version of its folder: JSON lines of records, failures and summary, report lines (place, line) in order, config in the manifest.

    Each table is computed once; a row that ``guarded`` refuses ends the job
    before anything can be read.
    """
    tables = {name: canonical_lines(guarded(rows)) for name, rows in (("records", records), ("failures", failures), ("summary", summary))}
    if report is not None:
        tables["report"] = report.orderBy("place").select(F.col("line").alias("value"))
    return versions.commit(records.sparkSession, path, replace=tables, text=tuple(tables), note=config or {})


def read_run(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the newest version of a run."""
    lines = versions.latest(spark, path).read(spark, name)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
