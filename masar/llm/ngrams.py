"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and mapped into memory by workers.

Three passes over the texts.  *Words*: every task counts the 64-bit hashes of its words; the counts meet in buckets of
the hash range and become sorted hash arrays in the shared folder, so that a word's place is its id.  *Pairs*: tasks turn
texts into sorted, counted (id, id) pairs, which meet in buckets of a mixed hash and become sorted pair arrays; the
contexts' and continuations' counts go on from there to arrays beside the words.  *Scores*: workers map all arrays
and look up the sorted distinct words and pairs of their own texts.  Nothing is pruned: what is gathered grows with the
corpus, and no array is ever read to the driver.  Each bucket holds a bounded share of distinct keys, as equal keys are
counted before the shuffle and keys are dealt by a hash, so a frequent word or a hot source makes no hot task.

The probability of w after v is (a(v, w) - D)/A(v) + g(v) P1(w), with discounts D1, D2, D3+ from the counts of counts, and P1 from
continuation counts, interpolated with the uniform 1/(V+1).  A text's first word follows its beginning, and its
last token is an end that no word equals.

Defined results: a null or empty text is its end alone; a row with a null id trains like the text '' of an id; repeated
rows count each time; without training texts every probability is 1/(V+1) = 1; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from masar.llm.blocks import counted, pack_numbers, pack_sorted, summed, unpack_numbers, unpack_sorted
from masar.llm.shared import array_folder, partitions, write_atomically
from masar.llm.textkit import U, chunks, mix, per_text, spans, word_hashes

#: Distinct keys that a task holds before it sends them on, and about as many in a bucket.
HELD = 2_000_000
BUCKET = 1_500_000
END = mix(np.array([0xE0D], U))[0]
START_ID = U(0xFFFFFFFF)


def tokens_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a chunk, each text's end included, and each text's bounds."""
    starts, ends = spans(raw, offs)
    words = word_hashes(raw, starts, ends)
    bounds = per_text(starts, offs)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def _emit(bucket: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket; keys are sorted within a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, values = bucket[order], keys[order], [v[order] for v in values]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(bucket[a]) for a, _ in parts], pa.int32()), pa.array([pack_sorted(keys[a:b]) for a, b in parts], pa.binary()), *(pa.array([pack_numbers(v[a:b]) for a, b in parts], pa.binary()) for v in values)],
        names=["bucket", "keys", *(f"v{k}" for k in range(len(values)))],
    )


class _Tally:
    """Keys with summed values; gives them back as rows by bucket whenever many are held."""

    def __init__(self, bucket_of, n_values: int) -> None:
        self.bucket_of, self.n_values = bucket_of, n_values
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, *values))
        self.size += len(keys)
        if self.size >= HELD:
            before = self.size
            self._merge()
            if self.size > before // 2:
                yield from self.flush()

    def _merge(self) -> None:
        self.held = [summed(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
        self.size = len(self.held[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            keys, *values = self.held[0]
            yield _emit(self.bucket_of(keys), keys, *values)
        self.held, self.size = [], 0


def _merged(table: pa.Table, n_values: int) -> tuple[np.ndarray, ...]:
    """The whole of one bucket: keys in order with their sums, folded row by row so that two copies are held at most."""
    held: list[tuple[np.ndarray, ...]] = []
    size, kept = 0, 0
    out = (np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(n_values)))
    for k in range(table.num_rows):
        row = (unpack_sorted(table["keys"][k].as_py()), *(unpack_numbers(table[f"v{j}"][k].as_py()) for j in range(n_values)))
        held.append(row)
        size += len(row[0])
        if size >= max(HELD // 2, kept):
            out = summed(*(np.concatenate([o, *h]) for o, h in zip(out, zip(*held, strict=True), strict=True)))
            held, size, kept = [], 0, len(out[0])
    return summed(*(np.concatenate([o, *h]) for o, h in zip(out, zip(*held, strict=True), strict=True))) if held else out


def _save(folder: str, name: str, array: np.ndarray) -> None:
    write_atomically(f"{folder}/{name}", np.ascontiguousarray(array).tobytes())


class _Files:
    """Arrays by bucket, each mapped when it is first asked for: a task opens only the files whose keys it meets."""

    def __init__(self, folder: str, name: str, dtype: type, shape: tuple[int, ...] = (-1,)) -> None:
        self.folder, self.name, self.dtype, self.shape = folder, name, dtype, shape
        self.mapped: dict[int, np.ndarray] = {}

    def __getitem__(self, bucket: int) -> np.ndarray:
        if bucket not in self.mapped:
            self.mapped[bucket] = _load(self.folder, f"{self.name}-{bucket}", self.dtype).reshape(self.shape)
        return self.mapped[bucket]


def _load(folder: str, name: str, dtype: type) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)


def _find(keys: np.ndarray, arrays: _Files, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the sorted distinct keys stands in its bucket's array, and whether it does."""
    at, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    order = np.argsort(bucket, kind="stable")
    met, cuts = np.unique(bucket[order], return_index=True)
    for b, own in zip(met.tolist(), np.split(order, cuts[1:]), strict=False):
        if len(held := arrays[b]):
            spot = np.minimum(np.searchsorted(held, keys[own]), len(held) - 1)
            at[own], there[own] = spot, held[spot] == keys[own]
    return at, there


def _pow2(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


@dataclass(frozen=True)
class Model:
    """Where a model's arrays lie, and its few totals."""

    folder: str
    word_buckets: int
    pair_buckets: int
    bases: tuple[int, ...]
    tokens: int
    vocabulary: int
    texts: int
    pair_types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_gamma: float

    def word_bucket(self, words: np.ndarray) -> np.ndarray:
        return (words >> U(40)).astype(np.int64) * self.word_buckets >> 24

    def pair_bucket(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs) >> U(40)).astype(np.int64) * self.pair_buckets >> 24


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2 and D3+; where the counts of counts are too few, one absolute discount."""
    if not (n1 and n2 and n3 and n4):
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        return d, d, d
    y = n1 / (n1 + 2 * n2)
    out = tuple(k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return tuple(min(max(d, 0.05), k) for k, d in zip((0.95, 1.95, 2.95), out, strict=True))


def _cut(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([counts <= 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2])


class Reader:
    """A worker's view of the mapped arrays."""

    def __init__(self, model: Model, with_pairs: bool = True) -> None:
        m, f = model, model.folder
        self.model = m
        self.words, self.counts = _Files(f, "word", U), _Files(f, "count", np.int64)
        if with_pairs:
            self.stats = _Files(f, "stat", np.float64, (-1, 2))
            self.pairs, self.pair_counts = _Files(f, "pair", U), _Files(f, "paircount", np.uint32)
            self.start = _load(f, "start", np.float64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct hashes: ids (unknown: all ones), bucket and place in it."""
        bucket = self.model.word_bucket(hashes)
        at, there = _find(hashes, self.words, bucket)
        base = np.array(self.model.bases, np.int64)
        return np.where(there, base[bucket] + at, -1), bucket, at

    def gather(self, arrays: _Files, bucket: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), *arrays.shape[1:]), arrays.dtype)
        for b in np.unique(bucket[known]).tolist():
            own = np.flatnonzero(known & (bucket == b))
            out[own] = arrays[b][at[own]]
        return out


def by_bucket(rows: DataFrame, buckets: int) -> GroupedData:
    """Groups by bucket, with as many tasks as buckets where these are more than the session's partitions."""
    return rows.repartition(max(buckets, partitions(rows.sparkSession)), "bucket").groupBy("bucket")


def _word_stage(train: DataFrame, buckets: int, folder: str) -> tuple[list[int], int, int]:
    proto = Model(folder, buckets, 1, (), 0, 0, 0, 0, (0,) * 3, (0,) * 3, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(proto.word_bucket, 1)
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column(0)):
                yield from tally.add(*counted(tokens_of(raw, offs)[0]))
        yield from tally.flush()

    def save(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, n = _merged(table, 1)
        _save(folder, f"word-{bucket}", keys)
        _save(folder, f"count-{bucket}", n)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    made = by_bucket(train.mapInArrow(count, "bucket int, keys binary, v0 binary"), buckets).applyInArrow(save, "bucket int, types long, tokens long").collect()  # a row a bucket
    types = [0] * buckets
    for row in made:
        types[row["bucket"]] = row["types"]
    return types, sum(types), sum(row["tokens"] for row in made)


def _pair_stage(train: DataFrame, model: Model) -> tuple[int, list[int]]:
    folder, starts = model.folder, U(32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tally = Reader(model, False), _Tally(model.pair_bucket, 1)
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column(0)):
                tokens, bounds = tokens_of(raw, offs)
                distinct, where = np.unique(tokens, return_inverse=True)
                ids = reader.ids(distinct)[0].astype(U)[where]
                before = np.empty_like(ids)
                before[1:] = ids[:-1]
                before[bounds[:-1]] = START_ID
                yield from tally.add(*counted(before << starts | ids))
        yield from tally.flush()

    def save(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, n = _merged(table, 1)
        _save(folder, f"pair-{bucket}", keys)
        _save(folder, f"paircount-{bucket}", np.minimum(n, 2**32 - 1).astype(np.uint32))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "types": pa.array([len(keys)], pa.int64()), **{f"n{k}": pa.array([int((n == k).sum())], pa.int64()) for k in (1, 2, 3, 4)}})

    made = by_bucket(train.mapInArrow(count, "bucket int, keys binary, v0 binary"), model.pair_buckets).applyInArrow(save, "bucket int, types long, n1 long, n2 long, n3 long, n4 long").collect()  # a row a bucket
    return sum(r["types"] for r in made), [sum(r[f"n{k}"] for r in made) for k in (1, 2, 3, 4)]


def _context_stage(train: DataFrame, model: Model) -> list[int]:
    """Writes N1, N2, N3+ of each word as a context and its continuation count; returns the counts of counts."""
    folder, bases = model.folder, np.array([*model.bases, model.vocabulary], np.int64)
    spark = train.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket_of(keys: np.ndarray) -> np.ndarray:
            return np.where(keys == START_ID, len(bases) - 1, np.searchsorted(bases, keys.astype(np.int64), "right") - 1)

        tally = _Tally(bucket_of, 4)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                pairs, counts = _load(folder, f"pair-{b}", U), _load(folder, f"paircount-{b}", np.uint32)
                for at in range(0, len(pairs), HELD // 4):
                    p, n = np.array(pairs[at : at + HELD // 4]), counts[at : at + HELD // 4]
                    zero = np.zeros(len(p), np.int64)
                    yield from tally.add(*summed(p >> U(32), (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64), zero))
                    ids, c = counted(p & START_ID)
                    none = np.zeros(len(ids), np.int64)
                    yield from tally.add(ids, none, none, none, c)
        yield from tally.flush()

    def save(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, one, two, more, cont = _merged(table, 4)
        d = model.pair_discounts
        if bucket == len(bases) - 1:  # the beginnings of texts
            _save(folder, "start", np.array([model.texts, (one * d[0] + two * d[1] + more * d[2]).sum() / max(model.texts, 1)]))
            cont = np.zeros(0, np.int64)
        else:
            total = _load(folder, f"count-{bucket}", np.int64).astype(np.float64)
            out, at = np.zeros((len(total), 2)), keys.astype(np.int64) - bases[bucket]
            out[at, 0] = (one * d[0] + two * d[1] + more * d[2]) / total[at]
            out[at, 1] = cont
            _save(folder, f"stat-{bucket}", out)
        return pa.table({f"n{k}": pa.array([int((cont == k).sum())], pa.int64()) for k in (1, 2, 3, 4)} | {"n5": pa.array([int((cont > 4).sum())], pa.int64())})

    # one task for a few buckets of pairs
    every = spark.range(0, model.pair_buckets, 1, min(model.pair_buckets, 4096)).select(F.col("id").cast("int").alias("b"))
    made = by_bucket(every.mapInArrow(spread, "bucket int, keys binary, v0 binary, v1 binary, v2 binary, v3 binary"), len(bases)).applyInArrow(save, "n1 long, n2 long, n3 long, n4 long, n5 long").collect()  # a row a bucket
    return [sum(r[f"n{k}"] for r in made) for k in (1, 2, 3, 4, 5)]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts the model of all texts of ``docs`` and leaves its arrays in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    n_bytes, n_texts = size["bytes"] or 0, size["n"]
    folder = array_folder(spark, "ngrams")
    # About a word in 25 is new and two pairs in three at most, and a word has some 6 bytes: buckets of BUCKET keys or fewer.
    word_buckets = _pow2(n_bytes / 6 / 20 / BUCKET * 8)
    pair_buckets = _pow2(n_bytes / 6 * 0.7 / BUCKET)
    types, vocabulary, tokens = _word_stage(texts, word_buckets, folder)
    bases = tuple(int(x) for x in np.concatenate([[0], np.cumsum(types)[:-1]]))
    if vocabulary >= int(START_ID):
        raise ValueError("word ids have 32 bits")
    model = Model(folder, word_buckets, pair_buckets, bases, tokens, vocabulary, n_texts, 0, (0,) * 3, (0,) * 3, 0)
    if not n_texts:
        return model
    pair_types, (n1, n2, n3, n4) = _pair_stage(texts, model)
    model = Model(folder, word_buckets, pair_buckets, bases, tokens, vocabulary, n_texts, pair_types, discounts(n1, n2, n3, n4), (0,) * 3, 0)
    c1, c2, c3, c4, c5 = _context_stage(texts, model)
    d = discounts(c1, c2, c3, c4)
    gamma = (c1 * d[0] + c2 * d[1] + (c3 + c4 + c5) * d[2]) / pair_types
    return Model(folder, word_buckets, pair_buckets, bases, tokens, vocabulary, n_texts, pair_types, model.pair_discounts, d, gamma)


def token_scores(reader: Reader, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in training, and log10 probabilities, of the tokens of a chunk."""
    m = reader.model
    if not m.tokens:
        return np.zeros(len(tokens), np.int64), np.full(len(tokens), -np.log10(m.vocabulary + 1.0))
    distinct, where = np.unique(tokens, return_inverse=True)
    ids, bucket, at = reader.ids(distinct)
    known = ids >= 0
    count = reader.gather(reader.counts, bucket, at, known)
    stats = reader.gather(reader.stats, bucket, at, known)
    p1 = np.maximum(stats[:, 1] - _cut(stats[:, 1], m.word_discounts), 0) / m.pair_types + m.word_gamma / (m.vocabulary + 1)
    own = ids.astype(U)[where]
    place = np.empty(len(tokens), np.int64)
    place[1:] = where[:-1]
    place[bounds[:-1]] = len(distinct)
    context = np.append(count, m.texts).astype(np.float64)[place]
    share = np.append(stats[:, 0], reader.start[1])[place]
    before = np.append(ids, int(START_ID)).astype(U)[place]
    sure = known[where] & np.append(known, True)[place]
    pairs, back = np.unique((before[sure] << U(32)) | own[sure], return_inverse=True)
    pair_bucket = m.pair_bucket(pairs)
    spot, there = _find(pairs, reader.pairs, pair_bucket)
    n = reader.gather(reader.pair_counts, pair_bucket, spot, there).astype(np.float64)
    top = np.zeros(len(tokens))
    top[sure] = (n - _cut(n, m.pair_discounts))[back]
    seen = context > 0
    p = np.where(seen, top / np.where(seen, context, 1) + share * p1[where], p1[where])
    return count[where], np.log10(p)


SCORE_SCHEMA = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """key, the ``extra`` columns, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    extra = extra or {}
    names = list(extra)  # the function for workers can't hold columns
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("key"), *(c.alias(n) for n, c in extra.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        scale = np.log10(float(model.tokens + model.vocabulary + 1))
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for _, _, raw, offs in chunks(batch.column(0)):
                tokens, bounds = tokens_of(raw, offs)
                c, p = token_scores(reader, tokens, bounds)
                first = bounds[:-1]
                for col, x in zip(cols, (np.ones(len(c), np.int64), (c > 0).astype(np.int64), np.log10(c + 1.0) - scale, p), strict=True):
                    col.append(np.add.reduceat(x, first))
            n, k, base, own = (np.concatenate(x) if x else np.zeros(0) for x in cols)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(np.full(batch.num_rows, model.tokens, np.int64)), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=["key", *names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(run, ", ".join([f"`{n}` {kinds[n]}" for n in ["key", *extra]] + [SCORE_SCHEMA]))
    return out.select(F.col("key").alias(key), *extra, "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text has this remainder; a null key counts as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def score_held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Trains on the texts whose crc32(key) has another remainder, then scores all texts."""
    out = held_out(F.col(key), modulus, remainder)
    return score(docs, train(docs.filter(~out), text), key, text, {"held_out": out})
