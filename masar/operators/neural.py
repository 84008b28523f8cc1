"""Short-horizon inference: graph convolutions, a two-layer recurrent network and two heads, in numpy over Arrow batches.

The weights are given; without trained ones they are seeded, so only shapes and ranges mean something.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, HIDDEN, EMBEDDED, RECURRENT, STEPS = 16, 64, 32, 128, 12
JAM_HEAD, LEVEL_HEAD = (RECURRENT, 256, 128, 3), (RECURRENT, 128, 2)


@dataclass(frozen=True)
class Weights:
    """Matrices of the two convolutions, the two recurrent layers (input, state, bias) and the layers of the two heads (matrix, bias)."""

    conv: tuple[np.ndarray, ...]
    lstm: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]
    jam: tuple[tuple[np.ndarray, np.ndarray], ...]
    level: tuple[tuple[np.ndarray, np.ndarray], ...]


def seeded(seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    w = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    lstm = tuple((w(n, 4 * RECURRENT), w(RECURRENT, 4 * RECURRENT), np.zeros(4 * RECURRENT)) for n in (EMBEDDED, RECURRENT))
    head = lambda sizes: tuple((w(a, b), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False))
    return Weights((w(FEATURES, HIDDEN), w(HIDDEN, EMBEDDED)), lstm, head(JAM_HEAD), head(LEVEL_HEAD))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def normalised(adjacency: np.ndarray) -> np.ndarray:
    """Edge weights with self-loops, scaled by both ends' degrees."""
    a = adjacency + np.eye(len(adjacency))
    d = 1 / np.sqrt(a.sum(axis=1))
    return a * d[:, None] * d[None, :]


def _head(x: np.ndarray, layers: tuple[tuple[np.ndarray, np.ndarray], ...]) -> np.ndarray:
    for k, (matrix, bias) in enumerate(layers):
        x = x @ matrix + bias
        x = np.maximum(x, 0) if k < len(layers) - 1 else x
    return x


def infer(x: np.ndarray, weights: Weights, mixing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x: (rows, steps, features) -> jams at three horizons in 0..1, and two class probabilities.

    ``mixing`` (nodes x nodes) mixes the nodes of a row block; without it each row is a graph of its own.
    """
    for w in weights.conv:
        x = x @ w
        if mixing is not None:
            x = np.einsum("nm,mtf->ntf", mixing, x)
        x = np.maximum(x, 0)
    for into, back, bias in weights.lstm:
        h = c = np.zeros((len(x), RECURRENT))
        out = []
        for t in range(x.shape[1]):
            i, f, g, o = np.split(x[:, t] @ into + h @ back + bias, 4, axis=1)
            c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
            h = _sigmoid(o) * np.tanh(c)
            out.append(h)
        x = np.stack(out, axis=1)
    last = x[:, -1]
    logits = _head(last, weights.level)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return _sigmoid(_head(last, weights.jam)), e / e.sum(axis=1, keepdims=True)


def predict(windows: DataFrame, key: str, column: str, weights: Weights) -> DataFrame:
    """(key, jam_15, jam_30, jam_60, congested) for arrays of STEPS x FEATURES numbers; shorter ones give no row."""
    spark = windows.sparkSession
    held = spark.sparkContext.broadcast(weights)  # a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                jam, level = infer(np.stack(b[column].to_list()).reshape(len(b), STEPS, FEATURES).astype(float), held.value)
                yield pd.DataFrame({key: b[key], "jam_15": jam[:, 0], "jam_30": jam[:, 1], "jam_60": jam[:, 2], "congested": level[:, 1]})

    kind = dict(windows.dtypes)[key]
    return windows.filter(F.size(column) == STEPS * FEATURES).select(key, column).mapInPandas(run, f"{key} {kind}, jam_15 double, jam_30 double, jam_60 double, congested double")


def predict_graphs(windows: DataFrame, graph: str, node: str, column: str, weights: Weights, edges: dict[tuple[int, int], float], nodes: int) -> DataFrame:
    """(graph, node, jam_15, jam_30, jam_60, congested): each graph's nodes (0 to ``nodes`` - 1) mixed along the edges at every step.

    A graph is one window of all junctions, so its size is that of the road network and not of the data; nodes without readings count as noughts and give no row.
    """
    adjacency = np.zeros((nodes, nodes))
    for (a, b), weight in edges.items():
        adjacency[b, a] += weight
    mixing = normalised(adjacency)
    held = windows.sparkSession.sparkContext.broadcast((weights, mixing))  # a fixed size, and that of the road network

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, mix = held.value
        x = np.zeros((nodes, STEPS, FEATURES))
        at = group[node].to_numpy(int)
        x[at] = np.stack(group[column].to_list()).reshape(len(group), STEPS, FEATURES)
        jam, level = infer(x, own, mix)
        return pd.DataFrame({graph: group[graph], node: group[node], "jam_15": jam[at, 0], "jam_30": jam[at, 1], "jam_60": jam[at, 2], "congested": level[at, 1]})

    kinds = dict(windows.dtypes)
    return windows.filter(F.size(column) == STEPS * FEATURES).select(graph, node, column).groupBy(graph).applyInPandas(run, f"{graph} {kinds[graph]}, {node} {kinds[node]}, jam_15 double, jam_30 double, jam_60 double, congested double")
