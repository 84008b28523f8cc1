import random

import pytest
from itertools import combinations

import numpy as np
import xxhash

from masar.llm import simhash
from masar.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string"


def slow_fingerprint(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(rows, fps):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(rows))]


def check(spark, rows):
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    want = sorted(zip([i for i, *_ in rows], [f"{f:016x}" for f in fps], slow_components(rows, fps), strict=True), key=str)
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == want


def test_texts_of_every_kind(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(40)] + ["É", "Straße", "ΑΒ"]
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "one", ""), (5, "one TWO", ""), (6, "ONE\ntwo", ""), (6, "ONE\ntwo", ""), (None, "one two", ""), (None, "no other like this text", "")]
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 200]))]
        rows.append((100 + k, " ".join(words), ""))
        words[rng.randrange(len(words))] = "changed"
        rows.append((500 - k, "  ".join(words).upper(), ""))
    rows.append((7, " ".join(rng.choice(vocab) for _ in range(120_000)), ""))
    check(spark, rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def fingerprints_frame(spark, values):
    return spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")


def brute_groups(values):
    fps = list(values)
    comps = slow_components([(f,) for f in fps], fps)
    return sorted(map(sorted, __import__("functools").reduce(lambda d, x: d.setdefault(x[1], []).append(x[0]) or d, zip(fps, comps, strict=True), {}).values()))


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(300):  # a dense cloud: most share a partition's value
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6]))))
    for _ in range(300):
        v = rng.getrandbits(64)
        values |= {v, v ^ 1 << rng.randrange(64), v ^ 3 << rng.randrange(62), v ^ 7 << rng.randrange(61)}
    values |= {0, 2**64 - 1, 1, 1 << 63, 3 << 62}
    for hot in (4, 64):
        comps = {r["node"]: r["component"] for r in connected_components(simhash.links(fingerprints_frame(spark, values), hot=hot)).collect()}
        got = {}
        for v in values:
            s = int(np.uint64(v).view(np.int64))
            got.setdefault(comps.get(s, s), []).append(v)
        assert sorted(map(sorted, got.values())) == brute_groups(values)


def test_thresholds_add_up_and_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(20):
        costs = [[0.0, *np.sort(rng.random(3)).tolist()] for _ in range(4)]
        total, thresholds = simhash.allocate(costs, 3)
        assert sum(t + 1 for t in thresholds) == 3
        best = min(sum(c[u] for c, u in zip(costs, us, strict=True)) for us in np.ndindex(4, 4, 4, 4) if sum(us) == 3)
        assert abs(total - best) < 1e-12


def test_estimates_follow_correlation():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (20_000, 64))
    x[:, 1] = x[:, 0]
    both = x.T @ x
    groups = simhash.group_bits(both, len(x), 4)
    assert any({0, 1} <= set(g) for g in groups) and sorted(sum(groups, [])) == list(range(64))
    pairs = x[rng.permutation(len(x))]
    bits = [0, 1, 2, 3]
    near = (x[:, bits] != pairs[:, bits]).sum(axis=1)
    est = simhash.within(both, len(x), bits, 2)
    for t in range(3):
        assert abs(est[t] - (near <= t).mean()) < 0.02


@pytest.mark.parametrize("at_once", [True, False])
def test_components_of_paths_and_stars(spark, monkeypatch, at_once):
    if not at_once:
        monkeypatch.setattr("masar.llm.components.SLICE", 40)  # rounds
    edges = [(k, k + 1) for k in range(50)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, 6)] + [(-3, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 1000 for k in range(1000, 1200)} | {-3: -3, 2000: -3}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
