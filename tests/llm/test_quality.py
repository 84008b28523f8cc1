import random
import zlib

import numpy as np
import pyarrow as pa

from masar.llm import quality as q
from masar.llm.textkit import chunks

SCHEMA = "doc_id long, text string, quality string, words int"


def slow_statistics(text):
    raw = (text or "").encode()
    n = max(len(raw), 1)
    share = lambda members: sum(raw.count(bytes([b])) for b in set(members)) / n
    low = bytes(b + 32 if 65 <= b < 91 else b for b in raw)
    words = low.split()
    m = max(len(words), 1)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] or ([tuple(words)] if words else [])
    lines = [x for x in low.replace(b"\r", b"\n").split(b"\n") if x]
    letters = lambda w: any(b >= 128 or 97 <= b <= 122 for b in w)
    return [
        len(words), sum(map(len, words)) / m, max(map(len, words), default=0),
        share(range(65, 91)), share(range(48, 58)), share(q._SYMBOLS), share(q._MARKS), share(b" \t\n\r\x0b\x0c"), share(range(128, 256)), share(b"!"), share(b"|"), share(q._BRACKETS),
        len(set(words)) / m, max((words.count(w) for w in set(words)), default=0) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, len(set(grams)) / max(len(grams), 1),
        len(lines), len(words) / max(len(lines), 1), 1 - len(set(lines)) / len(lines) if lines else 0, sum(not letters(w) for w in words) / m,
    ]


def test_statistics():
    texts = ["", None, "One two, TWO two\n\n12 | 34!!\r\nx", " \n", "é É ñ\nabc\nabc\nabc", "a", "a a a a b b", "[x] <y> {z}\n" * 5, "word " * 3000]
    got = np.vstack([q.statistics(r, o) for _, _, r, o in chunks(pa.array(texts), 40)])
    assert np.allclose(got, [slow_statistics(t) for t in texts])


def made(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(["the", "of", "some", "plain", "Words", "here"]) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(rng.choice([20, 100]))]
        bad = rng.random() < 0.4
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        rows.append((k, " ".join(words), "x", 0))
        labels.append((k, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_compiled_rules(spark):
    rows, labels = made(1500)
    rows += [(9001, None, None, None), (9002, "", "", 1), (None, "some words", "", 1), (5, rows[5][1], "x", 0), (9003, "word " * 200_000, "", 0)]
    marks = spark.createDataFrame([*labels, (7, labels[7][1]), (None, 1), (8, None)], "doc_id long, quality int")
    got = q.classify(spark.createDataFrame(rows, SCHEMA), marks).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    hold = [r for r in got if r["held_out"] and r[0] in truth]
    assert len(hold) > 300 and np.mean([truth[r[0]] == r["predicted"] for r in hold]) > 0.97


def test_column_equals_model(spark):
    rows, labels = made(300, 3)
    x = np.array([slow_statistics(t) for _, t, *_ in rows])
    rules = q.fit(x, np.array([y for _, y in labels], float))
    assert rules.rules
    got = spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in q.STATS)).select(rules.column()).collect()
    assert np.allclose([r[0] for r in got], rules.score(x))


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = made(200, 1)
    wrong = [(k, 1 - y) if zlib.crc32(str(k).encode()) % 3 == 1 else (k, y) for k, y in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, q.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (labels, wrong))
    assert a == b


def test_without_labels_or_rows(spark):
    rows, _ = made(20)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in q.classify(spark.createDataFrame(rows, SCHEMA), none).collect()} == {0.5}
    assert q.classify(spark.createDataFrame([], SCHEMA), none).collect() == []
