"""Tables of longs as sorted arrays in the shared folder, for workers to map and search: joins without a shuffle of the larger side."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from masar.llm.shared import array_folder, write_atomically

PART_ROWS = 1_000_000


@dataclass(frozen=True)
class Sorted:
    """Parts in key order; equal keys may go on in the next part."""

    folder: str
    columns: tuple[str, ...]
    parts: tuple[tuple[int, int, int, int], ...]  # (number, rows, first key, last key)

    @property
    def rows(self) -> int:
        return sum(p[1] for p in self.parts)

    def open(self) -> "Opened":
        return Opened(self)


class Opened:
    """A worker's map of the arrays."""

    def __init__(self, table: Sorted) -> None:
        self.table, self.parts = table, table.parts
        self.mapped: dict[int, list[np.ndarray]] = {}

    def part(self, number: int) -> list[np.ndarray]:
        """The columns of a part, mapped when it is first asked for."""
        if number not in self.mapped:
            self.mapped[number] = [np.memmap(f"{self.table.folder}/{number}-{c}", np.int64, "r") for c in self.table.columns]
        return self.mapped[number]

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Whether each value is a key; in the values' shape."""
        distinct, where = np.unique(values, return_inverse=True)
        found = np.zeros(len(distinct), bool)
        found[self.find(distinct)[0]] = True
        return found[where].reshape(values.shape)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """All rows with one of the sorted distinct keys: (which key, the row's other columns)."""
        which: list[np.ndarray] = []
        found: list[list[np.ndarray]] = []
        for number, _, first, last in self.parts:
            a, b = np.searchsorted(keys, first, "left"), np.searchsorted(keys, last, "right")
            if a == b:
                continue
            columns = self.part(number)
            low, high = np.searchsorted(columns[0], keys[a:b], "left"), np.searchsorted(columns[0], keys[a:b], "right")
            n = high - low
            if not n.any():
                continue
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            which.append(np.repeat(np.arange(a, b), n))
            found.append([c[at] for c in columns[1:]])
        if not which:
            return np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in self.table.columns[1:]]
        return np.concatenate(which), [np.concatenate(x) for x in zip(*found, strict=True)]


def write_sorted(table: DataFrame, label: str, rows_in_part: int | None = None) -> Sorted:
    """Sorts a table of long columns by all of them, the key first, into parts of bounded size."""
    rows_in_part = rows_in_part or PART_ROWS
    names = tuple(table.columns)
    folder = array_folder(table.sparkSession, label)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = sum(b.num_rows for b in held)
        if rows:
            number = TaskContext.get().partitionId()
            columns = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(len(names))]
            for name, column in zip(names, columns, strict=True):
                write_atomically(f"{folder}/{number}-{name}", np.ascontiguousarray(column, np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, rows, int(columns[0][0]), int(columns[0][-1]))], names=["part", "n", "first", "last"])

    count = table.count()
    if not count:
        return Sorted(folder, names, ())
    parts = table.repartitionByRange(math.ceil(count / rows_in_part), *names).sortWithinPartitions(*names).mapInArrow(save, "part long, n long, first long, last long").collect()  # a row for a million
    return Sorted(folder, names, tuple(sorted(map(tuple, parts), key=lambda p: (p[2], p[3], p[0]))))


def members(df: DataFrame, column: str, table: Sorted, inside: bool = True) -> DataFrame:
    """The rows whose whole-number column is (or is not) a key of the table; null is in no table. Rows are judged where they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = table.open()
        for batch in batches:
            keys = batch.column(at).cast(pa.int64())
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            distinct, where = np.unique(keys.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
            found = np.zeros(len(distinct), bool)
            found[have.find(distinct)[0]] = True
            yield batch.filter(pa.array((found[where] & known) == inside))

    return df.mapInArrow(run, df.schema)
