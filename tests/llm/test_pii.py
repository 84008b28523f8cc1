import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from masar.llm import pii

SCHEMA = "doc_id long, text string, spans string, base int"


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def valid_card(rng, n=16):
    while True:
        s = "4" + "".join(rng.choice("0123456789") for _ in range(n - 1))
        if luhn(s):
            return s


def texts():
    rng = random.Random(3)
    pieces = ["a.b@c.d", "x@y", "@", "a@b@c.de", "a@b.c_d@e.f", "a..b@-c.-d", "_%+-@q.w.e.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.0255", "00000000000001.1.1.1", "1..2.3.4", "+1 (988) 555-2485", "+12345678", "+1--5", "+4915112345678 90", "++49 30 1234567", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "4111 1111 1111 1112", "12 - 34", "5 5 5 5 5 5 5 5 5 5 5 5", "0" * 12, "0" * 19, "0" * 20, "é", "😀", "word", "-", ".", " ", "(", "\n", "+1", "7"]
    out = []
    for _ in range(1500):
        out.append("".join(rng.choice(pieces) + rng.choice(["", " ", "-", ". "]) for _ in range(rng.randrange(9))))
    out += ["9" * 2_000, "a" * 2_000, "1." * 1_000, "1 " * 5_000, "a@" + "b." * 1_000, "+" + "1-" * 5_000, "a@b.c " * 1_000, "x " * 50_000 + "me@host.example.com 😀 " + valid_card(rng)]
    return out


def test_long_runs_take_no_stack_and_no_square_of_time(spark):
    n = 100_000
    rows = ["9" * n, "a" * n, "1." * n, "1 " * n, "a@" + "b." * n, "+" + "1-" * n, "a@b.c " * 3_000]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(rows)], SCHEMA)).collect()}
    assert [got[k]["n_email"] for k in range(7)] == [0, 0, 0, 0, 1, 0, 3_000]
    assert [got[k]["n_ip"] for k in range(7)] == [0, 0, n // 4, 0, 0, 0, 0]
    assert [got[k]["n_card"] + got[k]["n_phone"] for k in range(7)] == [0] * 7


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(texts())] + [(-1, None, None, None), (-2, "", "", 0), (None, "a@b.cd", "", 0), (5, texts()[5], "x", 1)]
    got = pii.digest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        want[i] = base(t or "")
    for r in got:
        b = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(listed(b).encode()).hexdigest(), r["doc_id"]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in b) for j in range(4)]
        have = r["spans"].split(",") if r["spans"] else []
        assert set(listed(b).split(",") if b else []) <= set(have)


def test_empty_table(spark):
    assert pii.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def planted(n, seed=0):
    """Texts with personal data that the base patterns miss, and decoys."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        good = valid_card(rng)
        bad = good[:-1] + str((int(good[-1]) + 1 + rng.randrange(8)) % 10)
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        kind = k % 4
        text = {0: f"the words {phone} {good} go on", 1: f"the words {bad} go on", 2: f"plain a{k}@mail{k % 7}.example.com text with call {phone}, and ip 10.2.3.{k % 250}", 3: f"pay with {good} or 12 and 300.2.3.4"}[kind]
        rows.append((k, text, good, phone, kind))
    return rows


def test_added_spans(spark):
    rows = planted(400)
    got = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame([(k, t, "", 0) for k, t, *_ in rows], SCHEMA)).collect()}
    for k, text, good, phone, kind in rows:
        cut = {text[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[k].split(",") if x)}
        if kind == 0:
            assert {phone, good} <= cut, (text, cut)
        if kind == 1:
            assert not cut, (text, cut)


def test_reliability_of_simulated_labelers():
    rng = np.random.default_rng(0)
    n = 20_000
    truth = rng.random(n) < 0.6
    right = (0.95, 0.97, 0.8, 0.6, 0.9)
    votes = np.column_stack([np.where(rng.random(n) < p, truth, ~truth) * 2 - 1 for p in right])
    votes[truth, pii.VALID] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    r = pii.expectation_maximisation(np.zeros(len(patterns), int), patterns, counts)
    assert abs(r.prior[0] - 0.6) < 0.02
    for j, p in enumerate(right):
        assert abs(r.tables[0][j, 0, 0] - p) < 0.03
    q = r.posterior(0, votes)
    assert ((q > 0.5) == truth).mean() > 0.97


def test_redaction(spark):
    rows = [("é a@b.cd, 😀 1.2.3.4!", [(2, 0, 8), (12, 1, 19)]), ("none", []), ("abcdef", [(0, 2, 4), (2, 3, 5)]), ("", [])]
    df = spark.createDataFrame(rows, "t string, s array<struct<start:int,kind:int,end:int>>")
    assert [r[0] for r in df.select(pii.redact(F.col("t"), F.col("s"))).collect()] == ["é <EMAIL>, 😀 <IP>!", "none", "<CARD>f", ""]


def test_starts_of_long_arrays(spark):
    lens = [(k * 7) % 11 for k in range(1000)]
    for n in (0, 1, 63, 64, 65, 1000):
        got = spark.createDataFrame([(lens[:n],)], "x array<int>").select(pii.starts_of(F.col("x"))).first()[0]
        assert got == [sum(lens[:k]) for k in range(n)]


def test_cards_with_every_digit_apart(spark):
    rows = [(k, f"card {sep.join('4111111111111111')} end", "", 0) for k, sep in enumerate(" -")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [r["n_card"] for r in pii.digest(docs).orderBy("doc_id").collect()] == [1, 1]
    assert [r["text"] for r in pii.redacted(docs).orderBy("doc_id").collect()] == ["card <CARD> end"] * 2
