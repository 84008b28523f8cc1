"""Admission and alert decisions that depend on the decisions before them.

Each is a pure transition (state, row) -> (state, decision).  ``fold`` runs it over a batch, ordered within each key;
``masar.streaming.stateful`` runs the same transition over a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

State = tuple
Step = Callable[[State | None, tuple], tuple[State, Any]]

LEVELS = ("FREE", "ADVISORY", "WARNING", "SERIOUS", "CRITICAL")


def quota(limit: int) -> Step:
    """A row (day, amount) is served whole if its key had used less than the limit on its day."""

    def step(state: State | None, row: tuple) -> tuple[State, bool]:
        day, amount = row
        seen, used = state or (None, 0)
        if seen != day:
            used = 0
        if used >= limit:
            return (day, used), False
        return (day, used + max(1, int(amount))), True

    return step


def token_bucket(per_minute: float, burst: float) -> Step:
    """A row (seconds) costs a token; tokens come back with time, up to the burst."""

    def step(state: State | None, row: tuple) -> tuple[State, bool]:
        (now,) = row
        tokens, last = state or (burst, now)
        tokens = min(burst, tokens + (now - last) * per_minute / 60.0)
        return (tokens - 1, now) if tokens >= 1 else (tokens, now), tokens >= 1

    return step


def fixed_window(limit: int, seconds: float) -> Step:
    """A row (seconds, amount) is admitted whole or not at all; a window starts with the first row after the last one ended."""

    def step(state: State | None, row: tuple) -> tuple[State, bool]:
        now, amount = row
        start, used = state or (now, 0)
        if now - start >= seconds:
            start, used = now, 0
        if used + amount > limit:
            return state or (now, 0), False
        return (start, used + amount), True

    return step


def alerts() -> Step:
    """A row (level, delay) against the last alert: new, escalation, improvement or none; an alert is the next comparison."""

    def step(state: State | None, row: tuple) -> tuple[State, str]:
        level, delay = row
        now = LEVELS.index(level) if level in LEVELS else 0
        if not state or state[0] is None:
            return ((level, delay), "new") if now >= 2 else ((None, None), "none")
        before, last = LEVELS.index(state[0]), state[1]
        if now >= 2 and (now > before or delay >= last + 10):
            return (level, delay), "escalation"
        if before >= 2 and (now <= 1 or now <= before - 2 or delay <= last - 10):
            return (level, delay), "improvement"
        return state, "none"

    return step


def once() -> Step:
    """A row (minutes before departure): the first within 20 minutes is sent, and no other."""

    def step(state: State | None, row: tuple) -> tuple[State, bool]:
        send = not state and 0 <= row[0] <= 20
        return ((True,) if state or send else (), send)

    return step


def lru(capacity: int) -> Step:
    """A row (name, size): whether the cache of bounded size holds the name; a miss stores it and drops the least recently used."""

    def step(state: State | None, row: tuple) -> tuple[State, bool]:
        name, size = row
        held = list(state or ())
        hit = any(n == name for n, _ in held)
        held = [x for x in held if x[0] != name] + [next((x for x in held if x[0] == name), (name, size))]
        while held and sum(s for _, s in held) > capacity:
            held.pop(0)
        return tuple(held), hit

    return step


def fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, ident: str, out: str, kind: str) -> DataFrame:
    """(key, ident, out): the decisions over a batch. The rows of a key come in order and in pieces, and only the state is kept."""
    names = dict(rows.dtypes)

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None  # no key equals it; a null key is one of its own
        for piece in pieces:
            made = []
            for k, i, *row in piece.itertuples(index=False):
                k = None if pd.isna(k) else k
                if k != last:
                    last, state = k, None
                state, decision = step(state, tuple(row))
                made.append((k, i, decision))
            yield pd.DataFrame(made, columns=[key, ident, out])

    dealt = rows.repartition(key).sortWithinPartitions(key, *order).select(key, ident, *inputs)
    return dealt.mapInPandas(run, f"{key} {names[key]}, {ident} {names[ident]}, {out} {kind}")
