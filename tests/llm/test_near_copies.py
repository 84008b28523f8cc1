import random

import corpus_pipeline as c
from tests.llm.test_paragraphs import words

SCHEMA = "doc_id long, text string, extra string"


def shingles(text):
    w = words(text or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def slow(rows):
    """The group of each row, by comparing all pairs."""
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if x >= 0.8 * (len(sets[a]) + len(sets[b]) - x):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def test_equal_to_all_pairs(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)] + ["É", "ß"]
    rows = [(1, None, "x"), (2, " \n", ""), (3, "one two", ""), (4, "ONE  two", ""), (None, "one two", ""), (None, None, ""), (None, "of no id", "a"), (None, "of NO id", "a"), (5, "same row", ""), (5, "same row", "")]
    for k in range(40):
        w = [rng.choice(vocab) for _ in range(rng.choice([60, 200, 400]))]
        rows.append((100 + k, " ".join(w), ""))
        for j in range(rng.choice([1, 3])):
            near = list(w)
            for _ in range(len(w) * rng.choice([1, 2, 4]) // 100):  # about 0.9, 0.8 and 0.7 alike
                near[rng.randrange(len(w))] = "changed"
            rows.append((1000 + 10 * k + j, " ".join(near).upper(), ""))
    w = [rng.choice(vocab) for _ in range(200)]
    rows += [(5000 + k, " ".join(w[:k] + [f"n{k}"] + w[k + 1 :]), "") for k in range(100)]  # many that share nearly all bands
    want = {}
    for r, g in zip(rows, slow(rows), strict=True):
        want[g] = min((x for x in (want.get(g), r[0]) if x is not None), default=None)
    got = [r["doc_id"] for r in c.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.values()))
    assert len(want) < len(rows) - 120


def test_empty_table(spark):
    assert c.drop_near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").collect() == []
