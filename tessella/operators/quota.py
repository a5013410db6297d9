"""Quota of turns: a day's total, turns at a time and turns a minute as one state machine over a log."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .flows import folded

# What a row of the log can be, and what becomes of it.
ACQUIRE, RELEASE, REFUND = "acquire", "release", "refund"
GRANTED, DAILY, BUSY, RATE = "granted", "daily_quota", "concurrent", "rate_limited"
RELEASED, REFUNDED, IGNORED = "released", "refunded", "ignored"


class Account:
    """One user's state: the day's count, what runs, accepted times of the last minute, leases of the day."""

    def __init__(self):
        self.used: dict[str, int] = {}
        self.running = 0
        self.minute: list[float] = []
        self.leases: dict = {}  # request: [day, still running, still refundable]

    def forget(self, day: str) -> None:
        """Earlier days count no more; leases stay while they run or belong to the day."""
        if day not in self.used:
            open_days = {d for d, runs, _ in self.leases.values() if runs}
            self.used = {d: n for d, n in self.used.items() if d in open_days} | {day: 0}
            self.leases = {r: x for r, x in self.leases.items() if x[1]}


def quota(log: DataFrame, per_day: int = 50, at_once: int = 1, per_minute: int = 5, busy_wait: int = 5) -> DataFrame:
    """log (user_id, event_id, request_id, kind, day, at in seconds, to_midnight in seconds) with outcome, wait and used.

    acquire: refused for the first of day, turns at a time, turns a minute that
    is full, and then leaves no trace: what an earlier check took is given
    back.  wait tells in how many seconds to try again.  release: the place of
    a request that runs is free again.  refund: a request's turn is given back
    to its day, once; the minute isn't.  Other rows, such as a second release
    or a refund of a request that was refused, are ignored.  used: turns of the
    row's day after it.

    Rows of a user are folded in order of at and event_id, as sorted batches go
    by; the state is the user's leases of a day.
    """

    def step(user: Account, request, kind, day, at, to_midnight):
        user.forget(day)
        wait = None
        if kind == ACQUIRE:
            user.minute = [t for t in user.minute if at - t < 60.0]
            if user.used[day] >= per_day:
                outcome, wait = DAILY, max(1, math.floor(to_midnight))
            elif user.running >= at_once:
                outcome, wait = BUSY, busy_wait
            elif len(user.minute) >= per_minute:
                outcome, wait = RATE, max(1, math.ceil(user.minute[0] + 60.0 - at))
            else:
                outcome = GRANTED
                user.used[day] += 1
                user.running += 1
                user.minute.append(at)
                user.leases[request] = [day, True, True]
        else:
            lease, outcome = user.leases.get(request), IGNORED
            if kind == RELEASE and lease and lease[1]:
                lease[1], outcome = False, RELEASED
                user.running -= 1
            elif kind == REFUND and lease and lease[2]:
                lease[2], outcome = False, REFUNDED
                user.used[lease[0]] = max(0, user.used.get(lease[0], 0) - 1)
        return user, (outcome, wait, user.used[day])

    rows = log.select("user_id", "event_id", "request_id", "kind", "day", F.col("at").cast("double").alias("at"), F.col("to_midnight").cast("double").alias("to_midnight"))
    return folded(rows, "user_id", ["at", "event_id"], ["request_id", "kind", "day", "at", "to_midnight"], "outcome string, wait long, used long", Account, step)
