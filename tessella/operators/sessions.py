"""Conversations: turns, history windows, compression, forks, counters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import collapse_ends, token_estimate


def turns(messages: DataFrame) -> DataFrame:
    """messages (session_id, seq, role, content) with tokens and turn (from 1).

    A user's message and the assistant's right after it are one turn; any
    other message is a turn of its own.  Where messages have a token_count, it
    counts; an estimate stands in where they don't, or where it is null.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    closes = (F.col("role") == "assistant") & (F.lag("role").over(order) == "user")
    estimate = token_estimate(F.col("content"))
    known = F.coalesce("token_count", estimate) if "token_count" in messages.columns else estimate
    opened = messages.withColumn("opens", F.when(F.coalesce(closes, F.lit(False)), 0).otherwise(1))
    return opened.withColumn("turn", F.sum("opens").over(order).cast("long")).withColumn("tokens", known.cast("long")).drop("opens")


def history(messages: DataFrame, budget: int = 4000, least: int = 2) -> DataFrame:
    """session_id, turn, tokens, kept: newest turns within the budget, at least two.

    Going back, the first turn that would overflow ends the window.
    """
    per = turns(messages).groupBy("session_id", "turn").agg(F.sum("tokens").alias("tokens"), F.min("seq").alias("first_seq"))
    back = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    total = F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))
    kept = (F.row_number().over(back) <= least) | (total <= budget)
    return per.select("session_id", "turn", "tokens", "first_seq", kept.alias("kept"))


def anchors(messages: DataFrame) -> DataFrame:
    """session_id, anchor_seq, anchor: the first message of a user."""
    first = F.min(F.when(F.col("role") == "user", F.struct("seq", "content")))
    return messages.groupBy("session_id").agg(first.alias("f")).select("session_id", F.col("f.seq").alias("anchor_seq"), F.col("f.content").alias("anchor"))


def compressible(messages: DataFrame, budget: int = 2000, keep: int = 8) -> DataFrame:
    """session_id, n_turns, tokens, upto: what can be summarised of sessions over the budget."""
    per = turns(messages).groupBy("session_id", "turn").agg(F.sum("tokens").alias("tokens"), F.max("seq").alias("last"))
    back = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    marked = per.withColumn("old", F.row_number().over(back) > keep)
    got = marked.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.count_if("old").alias("n_turns"), F.max(F.when(F.col("old"), F.col("last"))).alias("upto"))
    return got.where((F.col("tokens") > budget) & (F.col("n_turns") > 0)).select("session_id", "n_turns", "tokens", "upto")


def fork_points(messages: DataFrame, at: int) -> DataFrame:
    """session_id, fork_seq: the last answer at or before at, else 0."""
    found = F.max(F.when((F.col("role") == "assistant") & (F.col("seq") <= at), F.col("seq")))
    return messages.groupBy("session_id").agg(F.coalesce(found, F.lit(0)).cast("long").alias("fork_seq"))


def fork(messages: DataFrame, at: int) -> DataFrame:
    """Copies of the messages up to each session's fork point, numbered from 1."""
    cut = fork_points(messages, at)
    order = Window.partitionBy("session_id").orderBy("seq")
    own = messages.join(cut, "session_id").where(F.col("seq") <= F.col("fork_seq"))
    return own.select("session_id", F.row_number().over(order).cast("long").alias("seq"), "role", "content")


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """new (session_id, arrival, role, content) with the sequence numbers that follow each session's last."""
    last = log.groupBy("session_id").agg(F.max("seq").alias("last"))
    order = Window.partitionBy("session_id").orderBy("arrival")
    return new.join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("long").alias("seq"), "role", "content")


def rate_limited(events: DataFrame, limit: int = 5, window_s: float = 60.0) -> DataFrame:
    """events (user_id, event_id, at in seconds) with accepted.

    An attempt is accepted if fewer than limit accepted ones are younger than
    the window.  Rejected attempts don't count, so this isn't a window frame.
    But one that has fewer than limit attempts of any kind in its window is
    accepted whatever came before; ``lag`` finds the others, and only they are
    gone through one by one, as sorted batches go by, with the last limit
    accepted times in hand.
    """
    import pyarrow as pa

    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("double").alias("at"))
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    crowded = F.coalesce(F.col("at") - F.lag("at", limit).over(order) < window_s, F.lit(False))

    def run(batches):
        user, held = object(), []
        for batch in batches:
            out = np.ones(batch.num_rows, bool)
            users, at = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            todo = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            before = 0
            for i in [*todo.tolist(), batch.num_rows]:
                # what lies between crowded rows was accepted; limit of them are enough to know
                for j in range(max(before, i - limit), i):
                    if users[j] != user:
                        user, held = users[j], []
                    held.append(at[j])
                held, before = held[-limit:], i + 1
                if i < batch.num_rows:
                    if users[i] != user:
                        user, held = users[i], []
                    out[i] = sum(at[i] - t < window_s for t in held) < limit
                    if out[i]:
                        held = [*held[-limit + 1 :], at[i]] if limit > 1 else [at[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], names=["user_id", "event_id", "at", "accepted"])

    return rows.repartition("user_id").withColumn("crowded", crowded).sortWithinPartitions("user_id", "at", "event_id").mapInArrow(run, "user_id long, event_id long, at double, accepted boolean")


# The longest message that is passed on, in UTF-16 units, and what ends a shortened one.
MAX_CONTENT, CUT_MARK = 8000, "……（历史消息过长，已截断）"


def upstream(messages: DataFrame, limit: int = MAX_CONTENT) -> DataFrame:
    """messages without blank ones; longer contents end in a mark, which counts towards limit.

    A surrogate pair is never split: the text then is one unit shorter.
    """
    units = F.encode(F.col("content"), "UTF-16BE")
    room = limit - len(CUT_MARK)
    splits = F.hex(F.substring(units, 2 * room - 1, 1)).between("D8", "DB")
    short = F.decode(F.substr(units, F.lit(1), F.when(splits, 2 * room - 2).otherwise(2 * room)), "UTF-16BE")
    return messages.where(F.coalesce(collapse_ends(F.col("content")) != "", F.lit(False))).withColumn("content", F.when(F.octet_length(units) > 2 * limit, F.concat(short, F.lit(CUT_MARK))).otherwise(F.col("content")))
