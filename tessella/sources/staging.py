"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir.  Only a local session, where
    driver and executor are one process, may go on without that setting, in a
    temporary folder of its own; the setting itself can't be changed while a
    session runs.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tessella-')}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written below the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/tessella/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str, rows: int = 500_000) -> DataFrame:
    """df dealt by columns over so many partitions that each has about so many rows, so that what a task sorts doesn't grow with the table."""
    parts = max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)
