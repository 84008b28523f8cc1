import random
import re
from collections import defaultdict
from itertools import combinations

from masar.llm import decontaminate as d


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lower)


def slow_pairs(docs, items):
    out = set()
    for i, t, *_ in docs:
        a = tokens(t)
        for j, s in items:
            b = tokens(s)
            if len(b) < d.LEAST:
                continue
            w = min(d.WINDOW, len(b))
            if any(sum(x == y for x, y in zip(a[p : p + w], b[q : q + w], strict=False)) >= d.needed(w) for p in range(len(a) - w + 1) for q in range(len(b) - w + 1)):
                out.add((i, j))
    return out


def test_masks_hit_every_tolerated_pattern():
    for size in range(d.LEAST, d.WINDOW + 1):
        family = next(f for f in d.MASKS if size >= f)
        for k in range(size - d.needed(size) + 1):
            for wrong in combinations(range(size), k):
                assert any(not {o + p for p in mask} & set(wrong) for mask in d.MASKS[family] for o in range(size - mask[-1])), (size, wrong)


def data():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.choice([2, 3, 5])))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20, 40, 60, 200, 12, 25])]
    items += [(50, items[11][1]), (51, ""), (52, None), (53, "The, end"), (54, items[10][1] + " " + items[11][1])]
    docs = []
    for k in range(220):
        a = [word() for _ in range(rng.choice([0, 4, 30, 150]))]
        _, s = items[rng.randrange(16)]
        w = s.split()
        lo = rng.randrange(max(1, len(w) - 12)) if rng.random() < 0.4 else 0
        w = w[lo : lo + rng.choice([11, 12, 14, 200])]
        for p in range(len(w)):
            if rng.random() < rng.choice([0, 0.1, 0.2, 0.3]):
                w[p] = word()
        at = rng.randrange(len(a) + 1)
        docs.append((k, " ".join([*a[:at], *[x.upper() + "," if rng.random() < 0.2 and x.isascii() else x for x in w], *a[at:]]), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, docs[3][1], "x"), (902, docs[3][1], "x"), (903, " ".join(word() for _ in range(50_000)) + " " + items[12][1], "x")]
    return docs, items


def test_a_passage_of_many_items(spark):
    """Items that share a long passage, and documents with an inner part of it only."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10_000)}"
    passage = [word() for _ in range(60)]
    items = [(k, " ".join([word() for _ in range(k % 7)] + passage + [word() for _ in range(k % 5)])) for k in range(300)] + [(1000, None), (1001, "one two three four")]
    docs = [(k, " ".join([word() for _ in range(30)] + passage[20 : 20 + n] + [word() for _ in range(30)]), "") for k, n in enumerate([12, 15, 30, 40, 9, 11])]
    rows = d.contaminations(*frames(spark, docs, items)).collect()
    assert expanded(rows) == slow_pairs(docs, [x for x in items if x[1]])
    assert len(rows) < len(docs) * 40 + 600


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


def expanded(rows):
    """All pairs of a document and an item that the classes stand for."""
    docs, items = defaultdict(set), defaultdict(set)
    for r in rows:
        docs[r["item_class"]].add(r["doc_id"])
        items[r["item_class"]].add(r["item_id"])
    assert all(r["n_items"] == len(items[r["item_class"]]) for r in rows)
    return {(i, j) for c in docs for i in docs[c] for j in items[c]}


def test_against_brute_force(spark):
    docs, items = data()
    left, right = frames(spark, docs, items)
    rows = d.contaminations(left, right).collect()
    want = slow_pairs(docs, items)
    assert {(r[0], r[1]) for r in rows} <= want
    assert expanded(rows) == want
    texts = {i: t for i, t, *_ in docs}
    for r in rows:
        cut = tokens(texts[r[0]][r["char_start"] : r["char_end"]])
        item = dict(items)[r[1]]
        assert slow_pairs([(0, " ".join(cut))], [(1, item)])
        assert d.needed(r["best_of"]) <= r["best"] <= r["best_of"] and r["tokens"] <= len(cut)


def test_empty_tables(spark):
    docs, items = data()
    left, right = frames(spark, docs[:5], items)
    none, nothing = frames(spark, [], [])
    assert d.contaminations(left, nothing).collect() == [] and d.contaminations(none, right).collect() == []


def test_small_parts(spark, monkeypatch):
    docs, items = data()
    left, right = frames(spark, docs, items)
    want = expanded(d.contaminations(left, right).collect())
    monkeypatch.setattr(d, "ITEM_ROWS", 3)
    monkeypatch.setattr("masar.llm.arrays.PART_ROWS", 50)
    assert expanded(d.contaminations(left, right).collect()) == want == slow_pairs(docs, items)
