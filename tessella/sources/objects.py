"""Objects: files below a folder by their logical key, and archives that hold each content once.

An archive is a versioned store with two tables: ``contents`` (sha256,
content), written once for each digest, in parts by the digest's first
digit; ``entries`` (key, sha256, bytes, media_type).  Contents come first and
the manifest last, so an archive that can be read is whole; ``verified`` reads
all of it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.markup import image_key
from ..sources import versions
from .staging import staged

# Media types by a name's ending.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "md": "text/markdown", "jsonl": "application/jsonl", "html": "text/html"}


def media_type(key: Column) -> Column:
    ending = F.lower(F.regexp_extract(key, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ending), F.lit("application/octet-stream"))


def logical_key(path: Column, root: str) -> Column:
    """A path below root without it; one that isn't below root ends the job."""
    plain = root.rstrip("/").removeprefix("file:").rstrip("/")
    plain = "/" + plain.lstrip("/") if not root.split(":", 1)[0] in ("hdfs", "viewfs", "s3a", "abfss", "gs") else root.rstrip("/")
    bare = F.regexp_replace(path, "^file:/+", "/")
    return F.when(F.startswith(bare, F.lit(plain + "/")), F.substr(bare, F.lit(len(plain) + 2))).otherwise(F.raise_error(F.concat(F.lit("outside the folder: "), path)).cast("string"))


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """key, content, bytes of the files below root whose name fits a pattern; without any, no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(logical_key(F.col("path"), root).alias("key"), "content", F.col("length").alias("bytes"))


def images(spark: SparkSession, root: str, prefix: str = "images") -> DataFrame:
    """key, content, bytes, media_type of the images below root/prefix; a name that ``image_key`` refuses is no image."""
    rows = scan(spark, root)
    return rows.where(image_key(F.col("key"), prefix) == F.col("key")).withColumn("media_type", media_type(F.col("key")))


def archive(spark: SparkSession, root: str, files: DataFrame, base: versions.Snapshot | None = None) -> versions.Snapshot:
    """Make files (key, content) what the archive holds; contents that it has already aren't written again.

    A key twice, or a null key or content, is an error.  Contents that no entry
    names any more stay, for older versions.
    """
    rows = staged(files.select("key", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), "content"), "files")
    if not rows.where("key is null or content is null").isEmpty() or not rows.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("files need a key and a content each, and no key twice")
    base = versions.latest(spark, root) if base is None else base
    new = rows
    if "contents" in base.tables:
        new = new.join(base.read(spark, "contents").select("sha256"), "sha256", "left_anti")
    # one writer of each digest: the smallest key names it
    first = new.groupBy("sha256").agg(F.min("key").alias("key"))
    contents = new.join(first, ["sha256", "key"], "left_semi").select("sha256", "content", F.left("sha256", F.lit(1)).alias("shelf"))
    entries = rows.select("key", "sha256", "bytes", media_type(F.col("key")).alias("media_type"))
    return versions.commit(spark, root, replace={"entries": entries}, append={"contents": contents}, by={"contents": "shelf"}, base=base)


def opened(spark: SparkSession, snapshot: versions.Snapshot, keys: DataFrame | None = None) -> DataFrame:
    """key, content, bytes, media_type of an archive's entries, or of those with a key in keys (key)."""
    entries = snapshot.read(spark, "entries")
    if keys is not None:
        entries = entries.join(keys.select("key"), "key", "left_semi")
    return entries.join(snapshot.read(spark, "contents").drop("shelf"), "sha256").select("key", "content", "bytes", "media_type")


def verified(spark: SparkSession, snapshot: versions.Snapshot) -> DataFrame:
    """key, error of the entries whose content is missing or isn't what its digest and size say."""
    held = snapshot.read(spark, "contents").select("sha256", F.sha2("content", 256).alias("real"), F.octet_length("content").cast("long").alias("size"))
    both = snapshot.read(spark, "entries").join(held, "sha256", "left")
    error = F.when(F.col("real").isNull(), "content is missing").when(F.col("real") != F.col("sha256"), "content is damaged").when(F.col("size") != F.col("bytes"), "size differs")
    return both.select("key", error.alias("error")).where("error is not null")


# Where a description names its book, and what is taken off a title's end.
QUOTED, AUTHOR, EDITION = "《(.+?)》", r"作者[：:]\s*([^\s　，,、；;]+)", "文库精校版$"


def book_metadata(text: Column) -> Column:
    """struct<title, author> of a book's description in Markdown.

    The title is the first heading of the first level: what stands in its
    quotation marks, else the heading, without the edition at the end.  A
    description without title or author ends the job.
    """
    heading = F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1))
    quoted = F.regexp_extract(heading, QUOTED, 1)
    name = F.trim(F.regexp_replace(F.when(quoted != "", quoted).otherwise(heading), EDITION, ""))
    known = lambda c, what: F.when(c != "", c).otherwise(F.raise_error(F.lit(f"the description has no {what}")).cast("string"))
    return F.struct(known(name, "title").alias("title"), known(F.regexp_extract(text, AUTHOR, 1), "author").alias("author"))
