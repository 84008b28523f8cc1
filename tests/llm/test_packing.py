import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from masar.llm import packing as k
from masar.llm.ranks import grouped_rank

SCHEMA = "doc_id long, text string, length string, batch int"


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, most = int(rng.integers(1, 10)), int(rng.integers(1, 6))
        lengths = np.sort(rng.choice(40, n, replace=False))
        counts = rng.integers(1, 50, n)
        got = k.boundaries(lengths, counts, most)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for m in range(min(most, n)) for c in combinations(lengths[:-1].tolist(), m))
        assert len(got) <= most and got[-1] == lengths[-1]
        assert padding(lengths, counts, got) == best


def test_batches_hold_the_budget_and_every_token(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(0.7)) % 700)), "x", 1) for i in range(600)]
    rows += [(900, None, "", 0), (901, "", "", 0), (902, " \n", "", 0), (3, rows[3][1], "", 0), (None, "a b c", "", 0), (903, "w " * 10_001, "", 0)]
    got = k.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), longest=256, buckets=5, budget=1024).collect()
    want = Counter((i, len((t or "").split())) for i, t, *_ in rows)
    whole = Counter()
    for i, n in want:
        for at in range(0, max(n, 1), 256):
            whole[i, at, min(256, n - at)] += want[i, n]
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in got) == whole
    batches, slots = defaultdict(list), defaultdict(set)
    for r in got:
        assert r["padding"] == r["padded_length"] - r["length"] >= 0
        batches[r["bucket"], r["batch"]].append(r["padded_length"])
        slots[r["bucket"], r["batch"]].add(r["slot"])
    for b, sizes in batches.items():
        assert len(set(sizes)) == 1 and (sum(sizes) <= 1024) and slots[b] == set(range(len(sizes)))
    for bucket in {b for b, _ in batches}:
        own = sorted(n for b, n in batches if b == bucket)
        assert own == list(range(len(own)))
        size = batches[bucket, 0][0]
        assert all(len(batches[bucket, n]) == max(1, 1024 // max(size, 1)) for n in own[:-1])
    histogram = Counter(r["length"] for r in got)
    lengths = np.array(sorted(histogram))
    assert sorted({r["padded_length"] for r in got}) == k.boundaries(lengths, np.array([histogram[x] for x in lengths.tolist()]), 5)


def test_empty_table(spark):
    assert k.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lengths_of_a_tokenizer(spark):
    import pyarrow as pa
    import pytest

    tokenizers = pytest.importorskip("public_tokenizers")
    measure = k.tokens_of(str(tokenizers.path("byte_bpe_50k.json")))
    assert measure(pa.array(["", None, "hello"])).tolist()[:2] == [0, 0] and measure(pa.array(["hello world"]))[0] == 2


def test_ranks_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None, 3 + i]), i % 50, str(i)) for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = grouped_rank(spark.createDataFrame(rows, "g long, x int, y string").repartition(6), "g", ["x", "y"], "r").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = defaultdict(list)
    for g, x, y in rows:
        groups[g].append((x, y))
    want = {(g, *row, n) for g, own in groups.items() for n, row in enumerate(sorted(own))}
    assert {tuple(r) for r in got} == want
