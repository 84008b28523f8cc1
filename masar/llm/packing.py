"""Packing into length buckets of least padding.

Texts are measured in tokens and cut into pieces of ``longest`` tokens at most.  The global histogram of piece lengths (one row for each
length, so bounded) goes to the driver, where dynamic programming chooses the bucket boundaries that make the sum of padding
least.  Inside each bucket, pieces in the order of a hash fill batches of a token budget; no group ever meets in one task.

Defined results: a null or empty text is one piece of no tokens in the smallest bucket; a row with a null key is packed like any other;
repeated rows are packed each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masar.llm.ranks import grouped_rank
from masar.llm.shared import materialize
from masar.llm.textkit import chunks, per_text, spans

LONGEST, BUCKETS, BUDGET = 2_048, 8, 16_384

Measure = Callable[[pa.Array], np.ndarray]


def words(texts: pa.Array) -> np.ndarray:
    """Words between blanks."""
    out = [np.diff(per_text(spans(raw, offs)[0], offs)) for _, _, raw, offs in chunks(texts)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def tokens_of(path: str) -> Measure:
    """Tokens of a tokenizer file of the ``tokenizers`` library; the file is the caller's."""
    held: list = []

    def measure(texts: pa.Array) -> np.ndarray:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
            held[0].encode_special_tokens = True
        return np.array([len(e.ids) for e in held[0].encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)], np.int64)

    return measure


def boundaries(lengths: np.ndarray, counts: np.ndarray, most: int) -> list[int]:
    """At most ``most`` of the distinct, sorted lengths, the longest included, such that padding each length up to the next boundary adds least.

    The cost of a bucket satisfies the quadrangle inequality, so the best cut moves one way and halving finds each row
    in n log n steps.
    """
    n = len(lengths)
    if not n:
        return []
    sizes = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    masses = np.concatenate([[0.0], np.cumsum(counts * lengths, dtype=float)])
    best = np.array([lengths[j - 1] * sizes[j] - masses[j] if j else 0.0 for j in range(n + 1)])
    cuts = [np.zeros(n + 1, int)]
    for _ in range(1, min(most, n)):
        new, cut = best.copy(), np.arange(n + 1)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            costs = best[i] + lengths[j - 1] * (sizes[j] - sizes[i]) - (masses[j] - masses[i])
            k = int(np.argmin(costs))
            new[j], cut[j] = costs[k], i[k]
            todo += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
        cuts.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(set(out))


def pieces(docs: DataFrame, key: str, text: str, longest: int, measure: Measure) -> DataFrame:
    """(key, piece, start, length): consecutive pieces of each text, in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(measure(batch.column(1)), pa.int64())], names=["key", "n"])

    kind = docs.schema[key].dataType.simpleString()
    sized = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n long")
    cut = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / longest).cast("int")))
    return sized.select("key", "n", F.explode(cut).alias("piece")).select("key", "piece", (F.col("piece").cast("long") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece").cast("long") * longest).cast("int").alias("length"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, measure: Measure = words) -> DataFrame:
    """key, piece, start, length, bucket (from 0), padded_length, batch (within the bucket), slot (within the batch), padding."""
    parts = materialize(pieces(docs, key, text, longest, measure), "pieces")
    histogram = np.array(sorted(map(tuple, parts.groupBy("length").agg(F.count("*").alias("n")).collect())), np.int64).reshape(-1, 2)  # longest + 1 rows at most
    ends = boundaries(histogram[:, 0], histogram[:, 1], buckets)
    bucket, capacity, padded = F.lit(None).cast("int"), F.lit(1).cast("long"), F.lit(0)
    for k, end in reversed(list(enumerate(ends))):
        fits = F.col("length") <= end
        bucket, padded = F.when(fits, k).otherwise(bucket), F.when(fits, end).otherwise(padded)
        capacity = F.when(F.col("bucket") == k, max(1, budget // max(end, 1))).otherwise(capacity)
    placed = parts.withColumn("bucket", bucket).withColumn("padded_length", padded).withColumn("h", F.xxhash64("key", "piece"))
    ranked = grouped_rank(placed, "bucket", ["h", "key", "piece", "start", "length"], "rank")
    batch = F.floor(F.col("rank") / capacity).cast("long")
    return ranked.select(F.col("key").alias(key), "piece", "start", "length", "bucket", "padded_length", batch.alias("batch"), (F.col("rank") - batch * capacity).cast("int").alias("slot"), (F.col("padded_length") - F.col("length")).alias("padding"))
