"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics of every whole text are computed in Arrow batches.  On a bounded sample of labelled rows (``MAX_LABELLED``, by a hash of
the key) boosted trees are grown; every path from a root becomes a conjunctive rule over statistics; a lasso logistic
regression keeps few of the rules and weighs them; the kept rules are compiled into one Spark column expression, which scores all
rows.

Defined results: a null or empty text has statistics of zero and is scored by the rules like any other; a row with a null id counts
as the text '' of an id and has no label; repeated rows are scored alike; labels that occur repeatedly count by their mean, null labels
not at all; without labels of both kinds every score is the smoothed share of label 1; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masar.llm.shared import materialize, unused
from masar.llm.textkit import U, chunks, per_text, spans, windows, word_hashes

MAX_LABELLED = 12_000
#: A sample of labelled keys of this size or less is broadcast.
BROADCAST_ROWS = 100_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
PENALTIES = (0.01, 0.002, 0.0005)

STATS = ("words", "mean_length", "longest", "upper", "digit", "symbol", "mark", "space", "high", "bang", "bar", "bracket", "distinct", "top", "again", "trigrams", "lines", "line_words", "same_lines", "bare")
_SYMBOLS, _MARKS, _BRACKETS = b"#$%&*+=@^_`~|\\/", b".,;:!?'\"-", b"<>[]{}()"
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def _class_matrix() -> np.ndarray:
    """A column for each kind of byte."""
    kinds = [range(65, 91), range(48, 58), _SYMBOLS, _MARKS, (32, 9, 10, 11, 12, 13), range(128, 256), b"!", b"|", _BRACKETS]
    out = np.zeros((256, len(kinds)))
    for k, members in enumerate(kinds):
        out[list(members), k] = 1
    return out


_CLASSES = _class_matrix()


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct hashes each text has, and how often its most frequent one stands."""
    n = len(bounds) - 1
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    owner = np.repeat(np.arange(n), np.diff(bounds)).astype(U)
    keys = np.sort(owner << U(40) | hashes >> U(24))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts, whose = np.diff(np.append(first, len(keys))), (keys[first] >> U(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, whose, counts)
    return np.bincount(whose, minlength=n).astype(float), top


def statistics(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATS for each text of a chunk."""
    n = len(offs) - 1
    sizes = np.diff(offs)
    cuts = offs.tolist()
    histogram = np.array([np.bincount(raw[a:b], minlength=256) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]).reshape(n, 256)
    shares = (histogram @ _CLASSES) / np.maximum(sizes, 1)[:, None]
    starts, ends = spans(raw, offs)
    bounds = per_text(starts, offs)
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    hashes, lens = word_hashes(raw, starts, ends), ends - starts
    longest, total = np.zeros(n), np.concatenate([[0], np.cumsum(lens)])
    full = np.flatnonzero(count)
    if len(full):
        longest[full] = np.maximum.reduceat(lens, bounds[full])
    distinct, top = _distinct(hashes, bounds)
    same = np.zeros(len(hashes) + 1, np.int64)
    same[1:-1] = np.cumsum(hashes[1:] == hashes[:-1]) if len(hashes) > 1 else 0
    same[-1] = same[-2] if len(hashes) else 0
    again = np.where(count > 1, same[np.maximum(bounds[1:] - 1, 0)] - same[np.minimum(bounds[:-1], len(hashes))], 0)
    grams, gram_bounds = windows(hashes, bounds, 3)
    trigrams = _distinct(grams, gram_bounds)[0] / np.maximum(np.diff(gram_bounds), 1)
    line_starts, line_ends = spans(raw, offs, _LINE)
    line_bounds = per_text(line_starts, offs)
    lines = np.diff(line_bounds)
    different = _distinct(word_hashes(raw, line_starts, line_ends), line_bounds)[0]
    letters = np.concatenate([[0], np.cumsum(((raw >= 128) | ((raw | 32) >= 97) & ((raw | 32) <= 122)).astype(np.int64))])
    bare = np.concatenate([[0], np.cumsum(letters[ends] == letters[starts])])
    cols = [count, (total[bounds[1:]] - total[bounds[:-1]]) / some, longest, *shares.T, distinct / some, top / some, again / some, trigrams, lines, count / np.maximum(lines, 1), 1 - different / np.maximum(lines, 1) - (lines == 0), (bare[bounds[1:]] - bare[bounds[:-1]]) / some]
    return np.column_stack(cols).astype(float)


def with_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, the STATS): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(1)):
                rows = statistics(raw, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c) for c in rows.T)], names=["key", *STATS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, " + ", ".join(f"{s} double" for s in STATS))


#: One condition: (index of the statistic, whether it must be over the threshold, threshold).
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Rules:
    """A logistic model over conjunctive rules."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * applies(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, of: Callable[[int], Column] = lambda k: F.col(STATS[k])) -> Column:
        """The score as a Spark expression over the statistics; ``of`` gives each one's column."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = None
            for k, over, t in rule:
                one = of(k) > t if over else of(k) <= t
                held = one if held is None else held & one
            z = z + F.when(held, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def applies(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, over, t in rule:
        out &= x[:, k] > t if over else x[:, k] <= t
    return out


def _tidy(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest condition of each kind, in order."""
    best: dict[tuple[int, bool], float] = {}
    for k, over, t in path:
        old = best.get((k, over), t)
        best[k, over] = max(old, t) if over else min(old, t)
    return tuple((k, over, t) for (k, over), t in sorted(best.items()))


def tree_paths(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, out: np.ndarray) -> list[tuple[Condition, ...]]:
    """Grows one tree on the gradients; adds its leaves' steps to ``out``; gives the path to each node."""
    paths: list[tuple[Condition, ...]] = []
    todo = [(rows, np.arange(len(x)), ())]
    while todo:
        own, every, path = todo.pop()
        if path:
            paths.append(_tidy(path))
        g, h = grad[own].sum(), hess[own].sum()
        best = (1e-3, None)
        if len(path) < DEPTH and len(own) >= 20:
            for k, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                b = binned[own, k]
                gl = np.cumsum(np.bincount(b, grad[own], len(cuts) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[own], len(cuts) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], (k, j))
        if best[1] is None:
            out[every] -= RATE * g / (h + 1)
            continue
        k, j = best[1]
        for over in (False, True):
            todo.append((own[(binned[own, k] > j) == over], every[(binned[every, k] > j) == over], (*path, (k, over, float(edges[k][j])))))
    return paths


def grow(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[tuple[Condition, ...]]:
    """Distinct rules from the paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    edges = []
    for col in x.T:
        values = np.unique(col)
        middle = (values[1:] + values[:-1]) / 2 if len(values) <= BINS else np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(middle)
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        found |= dict.fromkeys(tree_paths(x, binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), rows, z))
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 150) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty on the weights, by accelerated proximal steps."""
    n, m = r.shape
    mean = r.mean(axis=0)
    c = r - mean
    v = np.ones(m)
    for _ in range(20):
        v = c.T @ (c @ v)
        v /= np.linalg.norm(v) + 1e-12
    size = 1 / (0.25 * np.linalg.norm(c @ v) ** 2 / n * 1.05 + 0.25)
    w, b, t = np.zeros(m), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 1.0
    u, d = w, b
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(c @ u + d))) - y
        step = u - size * (c.T @ miss) / n
        new, new_b = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0), d - size * miss.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, d = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return float(b - mean @ w), w


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules and weights; the penalty is the one with the least loss on a fifth of the rows."""
    n1 = int(y.sum())
    if n1 == 0 or n1 == len(y) or len(y) < 10:
        return Rules(float(np.log((n1 + 1) / (len(y) - n1 + 1))), ())
    rules = grow(x, y)
    distinct: dict[bytes, tuple[Condition, ...]] = {}
    for rule in sorted(rules, key=lambda c: (len(c), c)):  # of rules that hold for the same rows the shortest
        held = applies(rule, x)
        if 0 < held.sum() < len(y):
            distinct.setdefault(np.packbits(held).tobytes(), rule)
    rules = list(distinct.values())
    if not rules:
        return Rules(float(np.log((n1 + 1) / (len(y) - n1 + 1))), ())
    r = np.column_stack([applies(rule, x) for rule in rules]).astype(np.float32)
    test = np.random.default_rng(1).random(len(y)) < 0.2
    scored = []
    for penalty in PENALTIES:
        if 0 < test.sum() < len(y) and 0 < y[~test].mean() < 1:
            b, w = lasso(r[~test], y[~test], penalty)
            z = r[test] @ w + b
            scored.append((float(np.mean(np.logaddexp(0, z) - y[test] * z)), penalty))
    b, w = lasso(r, y, min(scored)[1] if scored else PENALTIES[2])
    return Rules(b, tuple((rule, float(k)) for rule, k in zip(rules, w, strict=True) if abs(k) > 1e-6))


def held_out(key: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """Whether crc32 of the key as text has this remainder; a null key counts as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MAX_LABELLED) -> Rules:
    """Fits the rules on ``most`` labelled rows at most, those with the least hash of their key; of repeated keys one row counts.

    Only the texts of these rows are read into statistics, so learning costs no pass of its own over the others.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    sample = materialize(marks.filter(~held_out(F.col("k"))).withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(int(most)), "quality-labels")
    small = F.broadcast(sample) if most <= BROADCAST_ROWS else sample
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(small.select("k"), F.col("key") == F.col("k")).select("key", "text")
    stats = with_statistics(texts, "key", "text").groupBy("key").agg(F.min(F.struct(*STATS)).alias("s")).select("key", "s.*")
    got = stats.join(sample, F.col("key") == F.col("k")).select("h", *STATS, "y").toPandas().sort_values(["h", *STATS], kind="stable").to_numpy(float)[:, 1:]  # ``most`` rows at most
    return fit(got[:, :-1], got[:, -1])


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """(key, held_out, score, predicted, the STATS): one row per document."""
    rules = learn(docs, labels, key, text, label, most)
    scored = with_statistics(docs, key, text).withColumn("score", rules.column())
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *STATS)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """The documents whose predicted label is 1, with all their columns.

    Rules are learnt as in ``classify``; then rows are judged where they are, so no text is shuffled and repeated or null keys
    are no matter.
    """
    rules = learn(docs, labels, key, text, label, most)
    at, own = docs.columns.index(text), unused(docs, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column(at)):
                rows = statistics(raw, offs)
                packed = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), packed], names=[*batch.schema.names, own])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    judged = docs.mapInArrow(run, f"{kinds}, {own} array<double>")
    return judged.filter(rules.column(lambda k: F.get(own, F.lit(k))) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
