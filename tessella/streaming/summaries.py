"""Incremental summaries of conversations as one stateful operator.

A session's state is its mark (the last message that the summary covers, and
the summary), and the messages after it.  When an answer has arrived and the
messages after the mark hold more than ``budget`` tokens, all turns but the
last ``keep`` are summarised together with the summary before.  Summary and
mark advance together, in one write; where the model fails or says nothing,
neither does, and the next answer tries again.  A message that is covered or
already there is passed over, so a replayed batch changes nothing.  A deleted
session forgets everything and takes no more messages.

The outcome depends on the messages and their order, not on how they are cut
into batches.  Memory is a session's messages after its mark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunking import estimate
from ..operators.sessions import CUT_MARK, MAX_CONTENT

#: The summary before (or None) and the messages (role, content) that it has to absorb.
Summarise = Callable[[str | None, list[tuple[str, str]]], str]
RESULT = "session_id long, at_seq long, upto long, summary string, messages long, tokens long, status string"
#: Spark keeps state of this kind in RocksDB.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMMARISED, FAILED, DELETED = "summarised", "failed", "deleted"


def turns_of(messages: list[tuple[int, str, str]]) -> list[list[tuple[int, str, str]]]:
    """A user's message and the assistant's right after it are one turn; any other message is its own."""
    out: list[list[tuple[int, str, str]]] = []
    for m in messages:
        if m[1] == "assistant" and out and len(out[-1]) == 1 and out[-1][0][1] == "user":
            out[-1].append(m)
        else:
            out.append([m])
    return out


def plan(messages: list[tuple[int, str, str]], budget: int, keep: int) -> list[tuple[int, str, str]]:
    """What is to be summarised of the messages (seq, role, content) after the mark; nothing within the budget."""
    if sum(estimate(m[2]) for m in messages) <= budget:
        return []
    turns = turns_of(messages)
    return [m for turn in turns[: max(0, len(turns) - keep)] for m in turn]


def shortened(text: str, limit: int = MAX_CONTENT) -> str:
    """``sessions.upstream`` for one text: long ones end in a mark, and no surrogate pair is split."""
    units = text.encode("utf-16-be", "surrogatepass")
    if len(units) <= 2 * limit:
        return text
    cut = units[: 2 * (limit - len(CUT_MARK))]
    if 0xD8 <= cut[-2] <= 0xDB:
        cut = cut[:-2]
    return cut.decode("utf-16-be", "surrogatepass") + CUT_MARK


def carried(before: str | None, messages: list[tuple[str, str]]) -> str:
    """A stand-in for a model: how many parts were summarised, and their length."""
    return f"{len(messages) + (before is not None)} parts, {sum(len(c) for _, c in messages) + len(before or '')} characters"


class Summariser(StatefulProcessor):
    def __init__(self, model: Summarise, budget: int, keep: int):
        self.model, self.budget, self.keep = model, budget, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "upto long, summary string, deleted boolean")
        self.held = handle.getListState("held", "seq long, role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto, summary, deleted = self.mark.get() if self.mark.exists() else (None, None, False)
        held = [tuple(m) for m in self.held.get()] if self.held.exists() else []
        known = {m[0] for m in held}
        new = sorted({(int(r.seq), r.role, r.content) for batch in rows for r in batch.itertuples()}, key=lambda r: (r[0], str(r[1:])))
        out = []
        for seq, role, content in new:
            if deleted:
                break
            if role == DELETED:
                deleted, upto, summary, held = True, None, None, []
                out.append((key[0], seq, None, None, 0, 0, DELETED))
                continue
            if seq in known or (upto is not None and seq <= upto):
                continue
            known.add(seq)
            held = sorted([*held, (seq, role, content or "")])
            if role != "assistant":
                continue
            chosen = plan(held, self.budget, self.keep)
            payload = [(r, shortened(c)) for _, r, c in chosen if c.strip()]
            if not payload:
                continue
            tokens = sum(estimate(m[2]) for m in chosen)
            try:
                said = (self.model(summary, payload) or "").strip()
            except Exception:  # any provider error
                said = ""
            if said:
                upto, summary = chosen[-1][0], said
                held = held[len(chosen) :]
            out.append((key[0], seq, upto, summary, len(payload), tokens, SUMMARISED if said else FAILED))
        self.mark.update((upto, summary, deleted))
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"upto": "Int64"})

    def close(self) -> None:
        pass


def summaries(messages: DataFrame, model: Summarise = carried, budget: int = 4000, keep: int = 2) -> DataFrame:
    """RESULT: a row each time that a session (session_id, seq, role, content) is summarised, fails to be, or is deleted (a row of the role "deleted").

    messages may be a stream or a table.  at_seq is the answer that set the
    summary off.  The session's state store becomes ``PROVIDER``.
    """
    spark = messages.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = spark.streams.active  # a table's state store needs what the first stream of a session would start
    rows = messages.select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), "role", "content").where("session_id is not null and seq is not null and role is not null")
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Summariser(model, budget, keep), outputStructType=RESULT, outputMode="append", timeMode="none")


def marks(results: DataFrame) -> DataFrame:
    """session_id, upto, summary, runs, failed: where each session stands after results; deleted ones are left out."""
    good = F.col("status") == SUMMARISED
    got = results.groupBy("session_id").agg(F.max_by(F.struct("upto", "summary"), F.when(good, F.col("at_seq"))).alias("m"), F.count_if(good).alias("runs"), F.count_if(F.col("status") == FAILED).alias("failed"), F.max(F.col("status") == DELETED).alias("gone"))
    return got.where("not gone").select("session_id", "m.upto", "m.summary", "runs", "failed")
