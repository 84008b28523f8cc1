import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from masar.llm import ngrams

SCHEMA = "doc_id long, text string, key string, n_tokens long"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + [None]


class Slow:
    """The same model from dictionaries."""

    def __init__(self, texts):
        toks = [tokens(t) for t in texts]
        self.c, self.n = Counter(w for t in toks for w in t), sum(map(len, toks))
        self.pairs = Counter(p for t in toks for p in zip(["<s>", *t[:-1]], t, strict=True))
        self.ctx = Counter()
        self.follow = defaultdict(list)
        for (a, b), n in self.pairs.items():
            self.ctx[a] += n
            self.follow[a].append(n)
        self.cont = Counter(b for _, b in self.pairs)
        self.d2 = ngrams.discounts(*(sum(n == k for n in self.pairs.values()) for k in (1, 2, 3, 4)))
        self.d1 = ngrams.discounts(*(sum(n == k for n in self.cont.values()) for k in (1, 2, 3, 4)))

    @staticmethod
    def cut(n, d):
        return d[min(n, 3) - 1] if n else 0

    def p1(self, w):
        total = len(self.pairs)
        if not total:
            return 1 / (len(self.c) + 1)
        g = sum(self.cut(n, self.d1) for n in self.cont.values()) / total
        n = self.cont.get(w, 0)
        return (n - self.cut(n, self.d1)) / total + g / (len(self.c) + 1)

    def p(self, a, w):
        if not self.ctx.get(a):
            return self.p1(w)
        n, total = self.pairs.get((a, w), 0), self.ctx[a]
        return (n - self.cut(n, self.d2)) / total + sum(self.cut(x, self.d2) for x in self.follow[a]) / total * self.p1(w)

    def score(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c.get(w, 0) + 1) / (self.n + len(self.c) + 1)) for w in t)
        return len(t), sum(self.c.get(w, 0) > 0 for w in t), self.n, base, sum(math.log10(self.p(a, w)) for a, w in zip(["<s>", *t[:-1]], t, strict=True))


def rows():
    rng = random.Random(2)
    vocab = [f"v{int(rng.paretovariate(0.6))}" for _ in range(300)] + ["É", "Ünder"]
    out = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 60, 400]))), "k", 1) for k in range(80)]
    out += [(100, None, "k", None), (101, "", None, 1), (102, " \n", "", 1), (103, out[3][1].upper(), "", 1), (3, out[3][1], "", 1), (None, "v1 v2 unseen-there", "", 1), (104, "never seen words at all", "", 1)]
    out.append((105, " ".join(rng.choice(vocab) for _ in range(60_000)), "", 1))
    return out


def test_scores_of_all_texts(spark):
    data = rows()
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, *_ in data]
    assert any(held)
    model = Slow([t for (_, t, *_), h in zip(data, held, strict=True) if not h])
    want = sorted(((i, h, *model.score(t)) for (i, t, *_), h in zip(data, held, strict=True)), key=str)
    got = sorted((tuple(r)[:7] for r in ngrams.score_held_out(spark.createDataFrame(data, SCHEMA)).collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_add_up_to_one():
    model = Slow([t for _, t, *_ in rows()])
    for context in ("<s>", "v1", "unseen"):
        assert sum(model.p(context, w) for w in [*model.c, "unseen"]) == pytest.approx(1, abs=1e-9)


def test_many_small_buckets_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "HELD", 500)
    monkeypatch.setattr(ngrams, "BUCKET", 200)
    data = rows()
    model = Slow([t for _, t, *_ in data])
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in ngrams.score(docs, ngrams.train(docs)).collect() if r["doc_id"] is not None}
    for i, t, *_ in data:
        if i is not None and i != 3:
            assert tuple(got[i])[1:6] == pytest.approx(model.score(t), rel=1e-9)


def test_no_training_text_and_no_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngrams.score_held_out(empty).collect() == []
    one = spark.createDataFrame([(1, "a b", "", 1)], SCHEMA)
    r = ngrams.score(one, ngrams.train(empty)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
