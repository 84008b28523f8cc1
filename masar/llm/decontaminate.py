"""Benchmark decontamination by spaced-seed hashing.

Tokens are maximal runs of ASCII letters and digits and of all non-ASCII characters, A-Z as a-z.  A document is contaminated by an
item if some ``WINDOW`` consecutive tokens of both (or all of a shorter item's) agree in at least ``SHARE`` of the places: substitutions are
tolerated.  Fixed masks pick some places of a stretch of tokens and ignore the others.  For each length of item the masks are
chosen such that every tolerated pattern of substitutions leaves some mask a place where all that it picks agrees, so no
qualifying window is missed.  The items' seed hashes are sorted arrays that workers map; the hashes of the documents' tokens meet
them there, and each hit is verified on the tokens around it.  Documents are never shuffled and the benchmark is never
broadcast.  Seeds with equal surroundings are kept once, so a passage of very many items costs what one costs; the items that have them are
a *class*, with an id by its set of items.  Documents are reported by class, and the class's items are listed once, with the first of its documents: all
documents of a class overlap all its items, so no pair is lost and none is multiplied out.

Defined results: null and empty texts are clean; items of fewer than ``LEAST`` tokens are no evidence and are ignored; items with equal texts
are in all the same classes; a row with a null id is judged and returned with the null; repeated
documents are judged alike; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masar.llm.arrays import Sorted, write_sorted
from masar.llm.shared import array_folder, materialize, write_atomically
from masar.llm.textkit import NOT_ALNUM, U, chunks, mix, per_text, signed, spans, word_hashes

WINDOW, LEAST = 12, 5
#: Fifths of the places of a window that must agree.
SHARE = 4 / 5
#: Masks for items of at least so many tokens (found by a greedy cover of all patterns of tolerated substitutions).
MASKS = {
    12: ((0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8), (0, 1, 2, 3, 4, 5)),
    8: ((0, 1, 2, 4), (0, 1, 2, 3)),
    5: ((0, 1, 2), (0, 1, 3)),
}
ITEM_ROWS = 20_000
_PIECE = 20_000


def needed(window: int) -> int:
    """Places that must agree of a window."""
    return -(-window * 4 // 5)


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The hash at each place where the mask fits into the tokens."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, 0x51_7C_C1_B7_27_22_0A_95 + number, U)
    for place in mask:
        out = (out ^ tokens[place : place + n]) * U(0x9FB21C651E98DF25)
        out ^= out >> U(32)
    return mix(out)


def _tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = spans(raw, offs, NOT_ALNUM)
    return starts, ends, word_hashes(raw, starts, ends), per_text(starts, offs)


@dataclass(frozen=True)
class Index:
    """The benchmark's seeds, tokens and a bitmap of seed hashes, in the shared folder; a seed's last column is its class."""

    seeds: Sorted
    folder: str
    families: tuple[int, ...]
    bitmap_bits: int


def build_index(benchmark: DataFrame, key: str, text: str) -> tuple[Index, DataFrame]:
    """The index, and (class, item_key): the items of each class."""
    spark = benchmark.sparkSession
    folder = array_folder(spark, "benchmark")
    known = benchmark.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(key).alias("key"), F.xxhash64(text).alias("tid"))
    distinct = materialize(known.groupBy("text").agg(F.first("tid").alias("tid")), "benchmark")
    parts = max(1, -(-distinct.count() // ITEM_ROWS))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = TaskContext.get().partitionId(), 0
        path = f"{folder}/tokens-{part}"
        held: list[bytes] = []
        for batch in batches:
            for a, _, raw, offs in chunks(batch.column(0)):
                _, _, tokens, bounds = _tokens(raw, offs)
                held.append(tokens.tobytes())
                out: list[tuple[np.ndarray, ...]] = []
                for i in range(len(offs) - 1):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    own = tokens[lo:hi]
                    family = next((f for f in MASKS if len(own) >= f), 0)
                    padded = np.concatenate([np.zeros(WINDOW, U), own, np.zeros(WINDOW, U)])
                    for number, mask in enumerate(MASKS.get(family, ())):
                        h = seed_hashes(own, mask, family * 8 + number)
                        n = len(h)
                        if not n:
                            continue
                        pos = np.arange(n)
                        around = np.full(n, len(own) if len(own) < WINDOW else 0, U)
                        for k in range(2 * WINDOW):
                            around = mix(around * U(31) ^ padded[k + 1 : k + 1 + n])
                        at = (part << 40) + base + lo + pos
                        out.append((signed(h), signed(around), at, np.minimum(pos, WINDOW - 1), np.minimum(len(own) - pos, WINDOW), np.full(n, (part << 40) + base + lo), np.full(n, family)))
                    if family:
                        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 5 + [pa.array([(part << 40) + base + lo]), pa.array([family], pa.int64()), batch.column(1).slice(a + i, 1)], names=["seed", "around", "at", "left", "right", "item", "family", "tid"])
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.nulls(len(cols[0]), pa.int64())], names=["seed", "around", "at", "left", "right", "item", "family", "tid"])
                base += len(tokens)
        if base:
            write_atomically(path, b"".join(held))

    rows = distinct.repartitionByRange(parts, "text").select("text", "tid").mapInArrow(save, "seed long, around long, at long, left long, right long, item long, family long, tid long")
    rows = materialize(rows, "benchmark-seeds")
    items = rows.filter("seed is null").select("item", "tid")
    each = materialize(rows.filter("seed is not null").groupBy("seed", "around", "item").agg(F.min(F.struct("at", "left", "right")).alias("b")), "benchmark-each")
    mark = F.xxhash64(F.expr("bit_xor(xxhash64(item))"), F.expr("bit_xor(xxhash64(item, 1))"), F.count("*"))  # of the set of items, in any order
    kept = materialize(each.groupBy("seed", "around").agg(F.min("b").alias("b"), mark.alias("class")).select("seed", "around", "b.at", "b.left", "b.right", "class"), "benchmark-kept")
    seeds = write_sorted(kept.select("seed", "at", "left", "right", "class"), "benchmark-seeds")
    one = kept.groupBy("class").agg(F.min(F.struct("seed", "around")).alias("o")).select("class", F.col("o.seed").alias("s"), F.col("o.around").alias("r"))
    inside = each.join(one, (F.col("seed") == F.col("s")) & (F.col("around") == F.col("r"))).select("class", F.col("item").alias("i"))
    classes = inside.join(items, F.col("i") == F.col("item")).select("class", F.col("tid").alias("t")).join(known.select("tid", F.col("key").alias("item_key")).distinct(), F.col("t") == F.col("tid")).select("class", "item_key")
    families = tuple(sorted(r["family"] for r in rows.filter("seed is null").select("family").distinct().collect()))  # three at most
    bits = max(16, int(np.ceil(np.log2(max(seeds.rows, 1)))) + 4)
    _write_bitmap(kept.select("seed"), folder, bits)
    return Index(seeds, folder, families, bits), classes


def _write_bitmap(seeds: DataFrame, folder: str, bits: int) -> None:
    """Two bits for each byte of a seed; tasks write slices of the file, of whole pages where there are several."""
    path, cut = f"{folder}/bitmap", max(0, min(10, bits - 15))
    with open(path, "wb") as f:
        f.truncate(1 << bits - 3)

    def save(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << bits - 3 - cut, np.uint8)
        h = np.unique(np.concatenate([c.to_numpy(zero_copy_only=False) for c in table["seed"].chunks])).view(U) >> U(64 - bits)
        own = h & U((1 << bits - cut) - 1)
        np.bitwise_or.at(marks, (own >> U(3)).astype(np.int64), (U(1) << (own & U(7))).astype(np.uint8))
        with open(path, "r+b") as f:
            f.seek(int(h[0] >> U(bits - cut)) << bits - 3 - cut)
            f.write(marks.tobytes())
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    part = F.shiftrightunsigned("seed", 64 - cut) if cut else F.lit(0).cast("long")
    seeds.groupBy(part.alias("part")).applyInArrow(save, "n long").agg(F.sum("n")).collect()


class _Probe:
    """A worker's view of the index."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.seeds = index.seeds.open()
        self.bitmap = np.memmap(f"{index.folder}/bitmap", np.uint8, "r")
        self.parts: dict[int, np.ndarray] = {}

    def tokens(self, part: int) -> np.ndarray:
        if part not in self.parts:
            path = f"{self.index.folder}/tokens-{part}"
            self.parts[part] = np.memmap(path, U, "r") if os.path.exists(path) else np.zeros(1, U)
        return self.parts[part]

    def candidates(self, tokens: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """(token of the chunk, [at, left, right, class]) of the seeds that a chunk shares with the benchmark."""
        shift = U(64 - self.index.bitmap_bits)
        ends = bounds[1:]
        for family in self.index.families:
            for number, mask in enumerate(MASKS[family]):
                h = seed_hashes(tokens, mask, family * 8 + number)
                top = h >> shift
                may = np.flatnonzero(self.bitmap[(top >> U(3)).astype(np.int64)] >> (top & U(7)).astype(np.uint8) & 1)
                may = may[may + mask[-1] < ends[np.searchsorted(ends, may, "right")]] if len(may) else may
                if not len(may):
                    continue
                keys, where = np.unique(signed(h[may]), return_inverse=True)
                which, found = self.seeds.find(keys)
                if not len(which):
                    continue
                # every row of a key meets every place with that key, a piece of places at a time
                order = np.argsort(which, kind="stable")
                which, found = which[order], [c[order] for c in found]
                first, last = np.searchsorted(which, np.arange(len(keys)), "left"), np.searchsorted(which, np.arange(len(keys)), "right")
                n = (last - first)[where]
                where, may, n = where[n > 0], may[n > 0], n[n > 0]
                steps = np.concatenate([[0], np.cumsum(n)])
                at = 0
                while at < len(may):
                    to = max(at + 1, int(np.searchsorted(steps, steps[at] + _PIECE, "right")) - 1)
                    m = n[at:to]
                    row = np.repeat(first[where[at:to]] - (steps[at:to] - steps[at]), m) + np.arange(m.sum())
                    yield np.repeat(may[at:to], m), [c[row] for c in found]
                    at = to

    def hits(self, tokens: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of (text, class, first token, end token, agreeing tokens) of qualifying windows, distinct within a piece."""
        reach = np.arange(-(WINDOW - 1), WINDOW)
        for places, (at, left, right, item) in self.candidates(tokens, bounds):
            for lo in range(0, len(places), _PIECE):
                own = slice(lo, lo + _PIECE)
                place, spot, a, b, it = places[own], at[own], left[own], right[own], item[own]
                text = np.searchsorted(bounds, place, "right") - 1
                here = place[:, None] + reach
                valid = (here >= bounds[text][:, None]) & (here < bounds[text + 1][:, None]) & (reach >= -a[:, None]) & (reach < b[:, None])
                theirs = np.zeros(here.shape, U)
                part = spot >> 40
                for p in np.unique(part):
                    pick, store = part == p, self.tokens(int(p))
                    theirs[pick] = store[np.clip((spot[pick] & ((1 << 40) - 1))[:, None] + reach, 0, len(store) - 1)]
                same = valid & (tokens[np.clip(here, 0, len(tokens) - 1)] == theirs)
                ok, agree = (np.concatenate([np.zeros((len(place), 1), np.int64), np.cumsum(x, axis=1)], axis=1) for x in (valid, same))
                size = np.where(a + b < WINDOW, a + b, WINDOW)
                line, need = np.arange(len(place)), -(-size * 4 // 5)
                found: list[np.ndarray] = []
                for start in range(WINDOW):
                    end = np.minimum(start + size, 2 * WINDOW - 1)
                    good = (ok[line, end] - ok[:, start] == size) & (agree[line, end] - agree[:, start] >= need)
                    if good.any():
                        g = np.flatnonzero(good)
                        first = place[g] + reach[start]
                        found.append(np.column_stack([text[g], it[g], first, first + size[g], (agree[line, end] - agree[:, start])[g]]))
                if found:
                    yield _distinct_rows(np.concatenate(found))


def _distinct_rows(rows: np.ndarray) -> np.ndarray:
    """Distinct rows in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]


HIT_SCHEMA = "class long, char_start long, char_end long, tokens long, windows long, best long, best_of long"


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and class of items that it overlaps, and for each further item of a class one with its first document.

    key, item_key (the class's smallest, or the further item), item_class, n_items (of the class), char_start and char_end (code points
    around all qualifying windows), tokens (distinct document tokens in them), windows, best and best_of (agreeing tokens of the best window and its size).
    All items that stand with a class are overlapped by all documents that do.
    """
    index, classes = build_index(benchmark, item_key, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(index) if index.families else None
        for batch in batches:
            if probe is None:
                continue
            for a, _, raw, offs in chunks(batch.column(1)):
                starts, ends, tokens, bounds = _tokens(raw, offs)
                parts = list(probe.hits(tokens, bounds))
                if not parts:
                    continue
                hit = _distinct_rows(np.concatenate(parts))
                cut = np.flatnonzero(np.concatenate([[True], (hit[1:, :2] != hit[:-1, :2]).any(axis=1)]))
                rows = []
                for lo, hi in zip(cut, np.append(cut[1:], len(hit)), strict=True):
                    own = hit[lo:hi]
                    i = int(own[0, 0])
                    reach = np.maximum.accumulate(own[:, 3])
                    covered = int((own[:, 3] - own[:, 2]).sum() - np.maximum(0, np.minimum(reach[:-1], own[1:, 3]) - own[1:, 2]).sum())
                    first, last = int(starts[own[:, 2].min()]), int(ends[own[:, 3].max() - 1])
                    lead = raw[offs[i] : last] & 0xC0 != 0x80
                    best = own[np.lexsort((own[:, 2], -(own[:, 4] / (own[:, 3] - own[:, 2]))))[0]]
                    rows.append((a + i, int(own[0, 1]), int(lead[: first - offs[i]].sum()), int(lead.sum()), covered, len(own), int(best[4]), int(best[3] - best[2])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["key", "class", "char_start", "char_end", "tokens", "windows", "best", "best_of"])

    kind = docs.schema[key].dataType.simpleString()
    found = materialize(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {HIT_SCHEMA}"), "contaminations")
    met = found.select(F.col("class").alias("c")).distinct()
    items = materialize(classes.join(met, F.col("class") == F.col("c")).select("class", "item_key"), "contaminating-items")
    spans_of = ["char_start", "char_end", "tokens", "windows", "best", "best_of"]
    heads = items.groupBy(F.col("class").alias("c")).agg(F.min("item_key").alias("head"), F.count("*").alias("n_items"))
    firsts = found.groupBy("class").agg(F.min(F.struct("key", *spans_of)).alias("f"))
    ends = materialize(firsts.join(heads, F.col("class") == F.col("c")).select("c", "head", "n_items", "f"), "contamination-classes")
    rows = found.join(ends.select("c", "head", "n_items"), F.col("class") == F.col("c")).select("key", F.col("head").alias("item_key"), "class", "n_items", *spans_of)
    more = items.join(ends, (F.col("class") == F.col("c")) & ~F.col("item_key").eqNullSafe(F.col("head"))).select("f.key", "item_key", "class", "n_items", *(f"f.{x}" for x in spans_of))
    return rows.union(more).select(F.col("key").alias(key), F.col("item_key").alias(item_key), F.col("class").alias("item_class"), "n_items", *spans_of)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that no item overlaps, with all their columns; rows are judged where they are."""
    index, _ = build_index(benchmark, item_key, item_text)
    if not index.families:
        return docs
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(index)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, raw, offs in chunks(batch.column(at)):
                _, _, tokens, bounds = _tokens(raw, offs)
                for rows in probe.hits(tokens, bounds):
                    keep[a + rows[:, 0]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
