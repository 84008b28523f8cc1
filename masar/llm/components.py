"""Connected components of an edge table, by alternating large and small stars.

Every round first contracts what meets in a task by a local pass (no shuffle), then makes a large star and a small star:
each node's neighbours are hung under the smallest neighbour.  A node with very many edges is no hot task: its minimum
is pre-aggregated and its edges meet that minimum in a join that adaptive execution can split.  Rounds are written
to the shared folder, so that lost executors cost one round at most.  Fewer than ``SLICE`` edges are one local pass and need no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masar.llm.shared import discard, materialize

SLICE = 400_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that these edges tie it to), without the smallest nodes themselves."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contract(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            a, b = _roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size >= SLICE:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = edges.join(least, F.col("a") == F.col("k")).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), in any order and repeated at will -> (node long, component long).

    The component is its smallest node.  Nodes without an edge to another node don't occur in the result.
    """
    clean = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(_contract(clean).distinct(), "cc")
    small = now.limit(SLICE).count() < SLICE  # one task's pass ties all of them, whatever the size of the input
    if small:
        now = materialize(_contract(now.coalesce(1)), "cc")
    while not small:
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if not state["n"]:
            break
        large = materialize(_contract(_large_star(now)).distinct(), "cc")
        after = materialize(_contract(_small_star(large)).distinct(), "cc")
        moved = after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        discard(now)
        discard(large)
        now = after
        if moved == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
