import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Compare registered queries with their SQL on the smallest tables."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")

    def value(v):
        if v is None or type(v).__name__ == "NAType" or v != v:
            return None
        if isinstance(v, float) or type(v).__name__ in ("float32", "float64"):
            return float(f"{float(v):.9g}")
        return v if isinstance(v, (str, bool)) else int(v) if hasattr(v, "__int__") else str(v)

    def rows(df):
        df = df[sorted(df.columns)]
        return sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False, name=None)), key=str)

    def same(spark, query, sql):
        got, want = query(spark, sf).toPandas(), con.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return same
