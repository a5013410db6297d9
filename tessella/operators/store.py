"""Changes of keyed tables as DataFrames: what the table holds afterwards.

Write the result to a new folder and switch to it (sources.corpus), so a
failed job leaves the old table whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .evaluation import last_wins, upsert


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert after folding new to its last row of each key; null keys match null keys."""
    folded = last_wins(new, keys, order)
    same = reduce(lambda a, b: a & b, [old[k].eqNullSafe(folded[k]) for k in keys])
    return old.join(folded, same, "left_anti").unionByName(folded.select(*old.columns))


def purge(rows: DataFrame, **only: str | None) -> DataFrame:
    """Without the rows that have all the given values; none given: without all."""
    gone: Column = F.lit(True)
    for name, value in only.items():
        if value is not None:
            gone = gone & F.coalesce(F.col(name) == value, F.lit(False))
    return rows.where(~gone)


def count_up(usage: DataFrame, turns: DataFrame) -> DataFrame:
    """usage (day, user_id, turns) and one more for each row of turns (day, user_id)."""
    return usage.select("day", "user_id", "turns").unionByName(turns.select("day", "user_id", F.lit(1).cast("long").alias("turns"))).groupBy("day", "user_id").agg(F.sum("turns").alias("turns"))


def refund(usage: DataFrame, refunds: DataFrame) -> DataFrame:
    """usage less the refunds (day, user_id, request_id): each request once, never below zero; unknown keys add nothing."""
    back = refunds.select("day", "user_id", "request_id").distinct().groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("back"))
    return usage.join(back, ["day", "user_id"], "left").select("day", "user_id", F.greatest(F.col("turns") - F.coalesce("back", F.lit(0)), F.lit(0)).alias("turns"))


def retain(usage: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Rows of the last days (and of days that can't be read)."""
    return usage.where(F.coalesce(F.try_to_date(F.col("day")) >= F.date_sub(today, days), F.lit(True)))


def live_logins(logins: DataFrame, now: Column) -> DataFrame:
    """Logins that expire later; a time that can't be read has expired."""
    return logins.where(F.try_to_timestamp(F.col("expires_at")) > now)


def live_accounts(users: DataFrame, now: Column, ttl_days: int = 0) -> DataFrame:
    """Accounts younger than ttl_days (0: all); a time that can't be read hasn't expired."""
    if not ttl_days:
        return users
    return users.where(F.coalesce(F.try_to_timestamp(F.col("created_at")) + F.make_dt_interval(F.lit(ttl_days)) > now, F.lit(True)))


def cascade(users: DataFrame, sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of users, their sessions and messages without the users in gone; forks of lost sessions forget their origin."""
    left_users = users.join(gone.select("user_id"), "user_id", "left_anti")
    kept = sessions.join(gone.select("user_id"), "user_id", "left_anti")
    known = kept.select(F.col("session_id").alias("__origin"))
    forks = kept.join(known, kept["forked_from"] == known["__origin"], "left").withColumn("forked_from", F.col("__origin")).drop("__origin")
    return left_users, forks.select(*sessions.columns), messages.join(kept.select("session_id"), "session_id", "left_semi").select(*messages.columns)


def change(rows: DataFrame, changes: DataFrame, key: str, order: str, kind: str = "kind") -> DataFrame:
    """What a keyed table holds after inserts, updates and deletes (kind, key, order, and columns of rows), in order.

    insert makes the row, in place of one that is there; update changes the
    columns that aren't null, of a row that is there; delete takes it away.  An
    update after a delete, or of an unknown key, does nothing.  Changes of a key
    are folded once: for each column the last value since the last insert or
    delete, so a key's changes are aggregated before they are shuffled.
    """
    rest = [c for c in rows.columns if c != key]
    whole = F.col(kind).isin("insert", "delete")
    last = changes.groupBy(key).agg(F.max(F.when(whole, F.struct(F.col(order).alias("o"), F.col(kind).alias("k")))).alias("reset"))
    after = changes.join(last, key).where(F.coalesce(F.col(order) >= F.col("reset.o"), F.lit(True)))
    # the insert itself sets every column, null or not; updates only what they name
    value = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull() | (F.col(kind) == "insert"), F.col(order)))
    folded = after.groupBy(key).agg(F.first("reset").alias("reset"), *[value(c).alias(f"__{c}") for c in rest])
    both = rows.join(folded.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "full")
    made, gone, same = F.col("reset.k") == "insert", F.col("reset.k") == "delete", F.col("reset").isNull()
    alive = F.coalesce(made, F.lit(False)) | (same & F.col(key).isNotNull())
    own = [F.when(F.coalesce(made, F.lit(False)), F.col(f"__{c}.v")).otherwise(F.coalesce(F.col(f"__{c}.v"), F.col(c))).alias(c) for c in rest]
    return both.where(alive & ~F.coalesce(gone, F.lit(False))).select(F.coalesce(F.col(key), F.col("__key")).alias(key), *own).select(*rows.columns)


def page_after(rows: DataFrame, key: str, after, size: int = 100) -> DataFrame:
    """The next size rows by key: a top-k, no matter how far the paging has come."""
    return rows.where(F.col(key) > F.lit(after) if after is not None else F.lit(True)).orderBy(key).limit(size)


__all__ = ["cascade", "change", "count_up", "live_accounts", "live_logins", "page_after", "purge", "refund", "retain", "upsert", "upsert_last"]
