"""Places of rows within their groups, where a group may be larger than any task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from masar.llm.shared import materialize, partitions


def grouped_rank(df: DataFrame, group: str, order: Sequence[str], rank: str) -> DataFrame:
    """Adds the place, from 0, of each row within its group by the order.

    Rows are dealt by ranges of (group, order), so a large group spreads over many tasks; tasks count on from where their batches
    left off, and groups that several tasks share (two for each task at most) get offsets afterwards.  Null is a group.
    """
    rows = df.repartitionByRange(partitions(df.sparkSession), group, *order).sortWithinPartitions(group, *order)
    at = df.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, reached = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            place = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows)))
            if batch.column(at)[0].as_py() == last:
                place[: first[1] if len(first) > 1 else batch.num_rows] += reached
            last, reached = batch.column(at)[batch.num_rows - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(np.full(batch.num_rows, part, np.int32))], names=[*batch.schema.names, rank, "__part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    placed = materialize(rows.mapInArrow(number, f"{kinds}, `{rank}` long, __part int"), "ranks")
    sizes = placed.groupBy(group, "__part").agg((F.max(rank) + 1).alias("__n"))
    shared = sizes.groupBy(group).agg(F.collect_list(F.struct("__part", "__n")).alias("__all")).filter(F.size("__all") > 1)
    each = shared.select(F.col(group).alias("__g"), F.explode("__all").alias("__x")).select("__g", F.col("__x.__part").alias("__p"), F.col("__x.__n").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(each.select("__g", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")), "rank-offsets")
    joined = placed.join(F.broadcast(offsets), (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")  # two rows a task at most
    return joined.select(*df.columns, (F.col(rank) + F.coalesce("__offset", F.lit(0))).alias(rank))


