"""Streams: the admission transitions with managed state, triggers, and time-to-live."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from masar.operators.admission import Step

#: How often the scan and the collector run; one batch is active at a time.
SCAN_TRIGGER, COLLECT_TRIGGER = {"processingTime": "10 minutes"}, {"processingTime": "15 minutes"}


class Folding(StatefulProcessor):
    """Runs a transition over each key's rows of a micro-batch in order, and keeps its state for the next one."""

    def __init__(self, step: Step, key: str, ident: str, order: list[str], inputs: list[str], out: str, ttl_ms: int | None) -> None:
        self.step, self.key, self.ident, self.order, self.inputs, self.out, self.ttl_ms = step, key, ident, order, inputs, out, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("bytes", BinaryType())]), self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pieces = list(rows)
        batch = pd.concat(pieces).sort_values(self.order, kind="stable")
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        made = []
        for i, *row in batch[[self.ident, *self.inputs]].itertuples(index=False):
            state, decision = self.step(state, tuple(row))
            made.append((key[0], i, decision))
        self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(made, columns=[self.key, self.ident, self.out])

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, ident: str, out: str, kind: str, ttl_ms: int | None = None) -> DataFrame:
    """The streaming twin of ``masar.operators.admission.fold``."""
    names = dict(rows.dtypes)
    return rows.select(key, ident, *{*order, *inputs} - {key, ident}).groupBy(key).transformWithStateInPandas(Folding(step, key, ident, order, inputs, out, ttl_ms), f"{key} {names[key]}, {ident} {names[ident]}, {out} {kind}", "Append", "ProcessingTime" if ttl_ms else "None")


def fresh(cache: DataFrame, now: str, ttl_s: int, key: str = "key", time: str = "ts") -> DataFrame:
    """The latest row of each key of a cache that is younger than its time to live."""
    latest = cache.groupBy(key).agg(F.max(time).alias(time))
    return latest.filter(F.col(time) > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_s)))
