"""SimHash near-dedup by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it.  Texts are linked whose
fingerprints differ in at most ``distance`` bits.  The 64 bits are grouped into partitions of correlated bits; each
partition i gets a threshold T_i of its own with sum(T_i + 1) = distance + 1 (a pair within the distance must be within
T_i in some partition), chosen by dynamic programming on estimated candidate counts.  A fingerprint probes the values
within T_i of its own in partition i; candidates are verified on all 64 bits.  Equal fingerprints are one node.

A partition value that more than ``HOT`` fingerprints hold isn't expanded into pairs.  Its fingerprints emit the 65 keys
within one bit of themselves instead: two fingerprints within two bits share such a key, and all that share one are
within two bits of each other, so each key needs a star of links only.  That is exact for ``distance`` 2 and linear.

Defined results: null and empty texts and those without words have fingerprint zero and are linked like any other; a
text of fewer words than a shingle is one shingle; a row with a null id gets its fingerprint and its group's id but never names
a group; repeated rows are kept; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from masar.llm.arrays import members, write_sorted
from masar.llm.components import connected_components
from masar.llm.shared import materialize, unused
from masar.llm.textkit import LOWER_BYTES, column_bytes

BITS = 64
HOT = 64
SEED = 42
_PIECE = 50_000


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = raw.translate(LOWER_BYTES).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        digests, total = [xxhash.xxh64_digest(joined, SEED)], 1
        counts = np.unpackbits(np.frombuffer(digests[0], np.uint8)).astype(np.int64)
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens)[: n - width + 1].tolist()
        stops = ends[width - 1 :].tolist()
        total, counts = n - width + 1, np.zeros(BITS, np.int64)
        digest = xxhash.xxh64_digest
        for at in range(0, total, _PIECE):
            data = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _PIECE], stops[at : at + _PIECE], strict=True)])
            counts += np.add.reduce(np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = column_bytes(batch.column(1))
            view = memoryview(raw)
            found = np.fromiter((fingerprint(bytes(view[a:b]), width) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per fingerprint; column b is bit b."""
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(prints: DataFrame) -> np.ndarray:
    """How many of all fingerprints have both bits i and j; 64 x 64, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 100_000):
                x = _bits(np.ascontiguousarray(fp[at : at + 100_000])).astype(np.float32)
                total += np.rint(x.T @ x).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for row in prints.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4096 rows
        out[row["cell"]] = row["n"]
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Bits in groups of equal width, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    for g in range(groups):
        width = BITS // groups + (g < BITS % groups)
        rest = sorted(left)
        own = [max(rest, key=lambda b: (tie[b, rest].sum(), -b))]
        left.discard(own[0])
        while len(own) < width:
            pick = max(sorted(left), key=lambda b: (tie[b, own].sum(), -b))
            own.append(pick)
            left.discard(pick)
        out.append(own)
    return out


def within(both: np.ndarray, n: int, bits: list[int], most: int) -> list[float]:
    """Estimated shares of all pairs that differ in at most 0, 1, .. ``most`` of the bits: a chain over neighbouring bits."""
    one = np.diag(both) / max(n, 1)
    state = None
    for k, b in enumerate(bits):
        if k == 0:
            differ = 2 * one[b] * (1 - one[b])
            state = np.zeros((most + 1, 2))
            state[0, 0] = 1 - differ
            if most:
                state[1, 1] = differ
            before = differ
            continue
        a = bits[k - 1]
        p11 = both[a, b] / max(n, 1)
        p10, p01 = one[a] - p11, one[b] - p11
        p00 = 1 - p11 - p10 - p01
        cells = np.array([[p00**2 + p01**2 + p10**2 + p11**2, 2 * (p00 * p01 + p10 * p11)], [2 * (p00 * p10 + p01 * p11), 2 * (p00 * p11 + p01 * p10)]])
        step = cells / np.maximum(np.array([[1 - before], [before]]), 1e-12)
        new = np.zeros_like(state)
        new[:, 0] = state @ step[:, 0]
        new[1:, 1] = (state @ step[:, 1])[:-1]
        state, before = new, 2 * one[b] * (1 - one[b])
    return list(np.cumsum(state.sum(axis=1)))


def _ball(width: int, radius: int) -> int:
    return sum(len(list(combinations(range(width), k))) for k in range(radius + 1)) if radius >= 0 else 0


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds with sum(T + 1) = units and the least total cost; costs[i][u] is the cost of T_i = u - 1."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * units
    for cost in costs:
        best = [min(((best[u - k][0] + cost[k], [*best[u - k][1], k - 1]) for k in range(u + 1)), key=lambda x: x[0]) for u in range(units + 1)]
    return best[units]


def plan(both: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    choices = []
    for groups in range(2, 7):
        parts = group_bits(both, n, groups)
        costs = []
        for bits in parts:
            shares = within(both, n, bits, distance)
            costs.append([0.0, *(n * _ball(len(bits), t) + float(n) * n * shares[t] / 2 for t in range(distance + 1))])
        total, thresholds = allocate(costs, distance + 1)
        choices.append((total, groups, [(b, t) for b, t in zip(parts, thresholds, strict=True) if t >= 0]))
    return min(choices, key=lambda x: x[:2])[2]


def signatures(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, own): the value of each partition, and for thresholds over 0 the values around it (own false)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 50_000):
                fp = np.ascontiguousarray(every[at : at + 50_000])
                bits = _bits(fp).astype(np.int64)
                for k, (own, radius) in enumerate(parts):
                    value = (bits[:, own] << np.arange(len(own))).sum(axis=1)
                    for r in range(radius + 1):
                        for flips in combinations(range(len(own)), r):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(value ^ sum(1 << f for f in flips)), pa.array(fp), pa.array(np.full(len(fp), not r))], names=["part", "value", "fp", "own"])

    return prints.select("fp").mapInArrow(run, "part int, value long, fp long, own boolean")


def links(prints: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): links between distinct fingerprints that make the same components as all pairs within the distance."""
    if distance != 2:
        raise ValueError("values that very many fingerprints hold are split by keys for a distance of 2")
    both = bit_counts(prints)
    parts = plan(both, prints.count(), distance)
    rows = signatures(prints, parts)
    size = rows.groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own")).filter("n > 1 and n_own > 0")
    held = materialize(rows.join(size.select(F.col("part").alias("p"), F.col("value").alias("v"), "n"), (F.col("part") == F.col("p")) & (F.col("value") == F.col("v"))).select("part", "value", "fp", "own", "n"), "simhash-buckets")
    few = held.filter(F.col("n") <= hot)
    left, right = few.select("part", "value", F.col("fp").alias("a")), few.filter("own").select(F.col("part").alias("p"), F.col("value").alias("v"), F.col("fp").alias("b"))
    pairs = left.join(right, (F.col("part") == F.col("p")) & (F.col("value") == F.col("v"))).filter("a != b and bit_count(a ^ b) <= 2").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    dense = held.filter(F.col("n") > hot).select("fp").distinct()
    near = dense.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("k"))
    least = near.groupBy("k").agg(F.min("fp").alias("m"), F.count("*").alias("c")).filter("c > 1").select(F.col("k").alias("j"), "m")
    stars = near.join(least, F.col("k") == F.col("j")).filter("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return pairs.union(stars)


def groups(docs: DataFrame, key: str, text: str, width: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of all documents, and (fp, component, component_id) of all fingerprints."""
    prints = materialize(fingerprints(docs, key, text, width), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("key").alias("rep")), "simhash-distinct")
    comps = connected_components(links(distinct, distance))
    named = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id")).select(F.col("component").alias("c"), "component_id")
    return prints, materialize(named.join(least, F.col("component") == F.col("c")).select("fp", "component", "component_id"), "simhash-ids")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(key, fingerprint, component_id): one row per document; the component is the smallest key that links reach."""
    prints, ids = groups(docs, key, text, width, distance)
    named = ids.select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """The document with the smallest key of each group, with all its columns; of repeated rows one.

    Where a group has no row with a key, one of its rows stays.
    """
    prints, ids = groups(docs, key, text, width, distance)
    return first_of_each(docs, prints, ids, lambda texts: np.array([fingerprint((t or "").encode(), width) for t in texts.to_pylist()], np.uint64).view(np.int64), key, text)


def first_of_each(docs: DataFrame, prints: DataFrame, ids: DataFrame, values: Callable[[pa.Array], np.ndarray], key: str, text: str) -> DataFrame:
    """The documents that stay, by (key, fp) and (fp, component, component_id); ``values`` computes fp of a column of texts."""
    least, fp, group = (unused(docs, n) for n in ("least_id", "fp", "group"))
    firsts = materialize(ids.filter("component_id is not null").select(F.col("component_id").alias(least)).distinct(), "simhash-firsts")
    again = materialize(prints.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1 and key is not null").select(F.col("key").alias(least)), "simhash-again")
    if isinstance(docs.schema[key].dataType, IntegralType):  # no text is shuffled: the ids kept are arrays that workers map
        as_long = lambda t: write_sorted(t.select(F.col(least).cast("long").alias("id")), "simhash-ids")
        kept, repeated = members(docs, key, as_long(firsts)), as_long(again)
        if repeated.rows:
            kept = members(kept, key, repeated, inside=False).union(members(kept, key, repeated).dropDuplicates([key]))
    else:
        kept = docs.join(firsts, F.col(f"`{key}`") == F.col(least), "left_semi")
        if not again.isEmpty():
            kept = kept.dropDuplicates([key])
    if prints.filter("key is null").isEmpty():
        return kept
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values(batch.column(at)))], names=[*batch.schema.names, fp])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    unnamed = docs.filter(F.col(key).isNull()).mapInArrow(run, f"{kinds}, {fp} long")
    other = unused(docs, "other_fp")
    alone = unnamed.join(ids.filter("component_id is null").select(F.col("fp").alias(other), F.col("component").alias(group)), F.col(fp) == F.col(other)).dropDuplicates([group])
    return kept.union(alone.select(*(F.col(f"`{c}`") for c in docs.columns)))
