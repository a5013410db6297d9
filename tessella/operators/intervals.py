"""Joins of intervals: each is dealt to the bins of positions that it touches, and bins are joined by equality.

A nested loop over all intervals of a key, however many it has, never runs:
two intervals meet only in bins that both touch, and of the bins that they
share only the first one reports them.  Bins of one key lie in many tasks, so a
key with very many intervals is split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def dealt(rows: DataFrame, start: Column, end: Column, width: int, name: str) -> DataFrame:
    """rows once for each bin of width that [start, end) touches; an empty interval has the bin of its start."""
    first, last = F.floor(start / width), F.floor((F.greatest(end - 1, start)) / width)
    return rows.withColumn(name, F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap, once each.

    left has start and end, right has other_start and other_end, [start, end);
    other columns differ in name.  width: about the length of the longer kind
    of interval; a smaller one makes more copies, a larger one more candidates.
    Nulls in a key, start or end match nothing.
    """
    if width < 1:
        raise ValueError("bins need a width of 1 or more")
    own = {k: f"__right_{k}" for k in keys}
    a = dealt(left, F.col("start"), F.col("end"), width, "__bin")
    b = dealt(right.withColumnsRenamed(own), F.col("other_start"), F.col("other_end"), width, "__other_bin")
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(o) for k, o in own.items()], F.col("__bin") == F.col("__other_bin"))
    touch = (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end"))
    once = F.col("__bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("other_start") / width))
    return a.join(b, same & touch & once).drop("__bin", "__other_bin", *own.values())
