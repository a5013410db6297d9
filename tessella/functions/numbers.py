"""Ratios, similarities and hash-derived numbers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def show_ratio(value: Column, bottom: Column) -> Column:
    """Four decimals; a dash for a zero denominator, ? for a missing one."""
    return F.when(bottom.isNull(), "?").when(bottom == 0, "—").otherwise(F.format_string("%.4f", value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; vectors of different lengths are an error."""
    safe = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return F.coalesce(safe, dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def hash_score(*parts: Column) -> Column:
    """A number in [0, 1] from the first 64 bits of a hash: the same everywhere."""
    return F.conv(F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(16)), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def progress(done: Column, all_: Column) -> Column:
    """done of all_ between 0 and 1; 0 of nothing."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(done, all_)))


def ceil_div(n: Column, by: int) -> Column:
    return -F.floor(-n / F.lit(by)).cast("long")
