"""Stateful streams: rate limits and refusal detection, per key.

State is a few numbers or a few characters per key and times out, so it stays
bounded by the number of active keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import REFUSAL

LIMIT, WINDOW_S = 5, 60.0


def accept(times: list[float], held: list[float], limit: int = LIMIT, window: float = WINDOW_S) -> tuple[list[bool], list[float]]:
    """Decisions for attempts in order; only accepted ones count."""
    out = []
    for at in times:
        held = [t for t in held if at - t < window]
        out.append(len(held) < limit)
        if out[-1]:
            held = [*held, at]
    return out, held


def rate_limit(attempts: DataFrame, limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """attempts (user_id long, event_id long, at double) with accepted, as a stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        held = list(state.get[0]) if state.exists else []
        rows["accepted"], held = accept(rows["at"].tolist(), held, limit, window)
        state.update((held,))
        state.setTimeoutDuration(int(window * 1000))
        yield rows[["user_id", "event_id", "at", "accepted"]]

    return attempts.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, at double, accepted boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def verdict(pending: str) -> str:
    """answer, refusal or pending for the beginning of an answer."""
    rest = pending.lstrip()
    if rest.startswith(REFUSAL):
        return "refusal"
    if len(pending) - len(rest) > 8:
        return "answer"
    return "pending" if REFUSAL.startswith(rest) else "answer"


def release(texts: list[str], pending: str, decided: str) -> tuple[list[str], str, str]:
    """What may be shown of each piece: nothing until the beginning is decided, nothing of a refusal."""
    out = []
    for t in texts:
        if decided == "pending":
            pending += t
            decided = verdict(pending)
            out.append(pending if decided == "answer" else "")
            pending = pending if decided == "pending" else ""
        else:
            out.append(t if decided == "answer" else "")
    return out, pending, decided


def answers(deltas: DataFrame) -> DataFrame:
    """deltas (request_id string, seq long, text string) with what may be shown of each, as a stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        pending, decided = state.get if state.exists else ("", "pending")
        rows["shown"], pending, decided = release(rows["text"].tolist(), pending, decided)
        rows["verdict"] = decided
        state.update((pending, decided))
        state.setTimeoutDuration(600_000)
        yield rows[["request_id", "seq", "shown", "verdict"]]

    return deltas.groupBy("request_id").applyInPandasWithState(step, "request_id string, seq long, shown string, verdict string", "pending string, decided string", "append", GroupStateTimeout.ProcessingTimeTimeout)
