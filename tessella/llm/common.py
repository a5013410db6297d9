"""Helpers shared by the training-data operators.

Word rules
    ``words_of`` splits on ``[\\x20\\x09-\\x0D]+`` only: ``bytes.split()``
    without arguments splits on exactly those six ASCII characters.

Staging
    ``stage`` writes an intermediate table as Parquet below the shared folder
    named by ``spark.checkpoint.dir`` and reads it back.  That cuts the
    lineage, so a lost executor costs a reread and never a recomputation of
    the expensive part, and nothing depends on an executor's own disk.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import shared_dir

#: Java regular expression of one run of the separators that words_of uses.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: ... and of one word.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a whole text; None has none."""
    return utf8(text).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_STAGED: list[str] = []


def stage_path(spark: SparkSession, label: str) -> str:
    _STAGED.append(f"{shared_dir(spark)}/tessella/{label}-{uuid.uuid4().hex}")
    return _STAGED[-1]


def clear_stages(spark: SparkSession) -> None:
    """Delete what this process has staged; call it when results that read from there are written."""
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return what is read back."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that clashes with none of df's, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols: str, seed: int) -> "F.Column":
    """48 bits of md5 over seed and columns as a long: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])), 1, 12), 16, 10).cast("long")


def parts(batch: pa.RecordBatch, *text_columns: int, limit: int = 2_000_000):
    """A record batch in slices whose texts have about limit bytes (one row at least).

    Python objects are made of one slice at a time, so memory follows the
    longest text, not the number of rows that Spark puts into a batch.
    """
    n = batch.num_rows
    ends = np.zeros(n, np.int64)
    for i in text_columns:
        ends += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(ends)
    at = 0
    while at < n:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches, *text_columns: int, limit: int = 2_500_000):
    """Record batches cut and put together again to texts of about limit bytes each."""
    held, size = [], 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        for own in parts(batch, *text_columns, limit=limit // 8):
            n = sum(pc.sum(pc.binary_length(own.column(i))).as_py() or 0 for i in text_columns)
            if held and size + n > limit:
                yield joined()
                held, size = [], 0
            held.append(own)
            size += n
    if held:
        yield joined()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark send at most rows rows of whole texts to Python at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
