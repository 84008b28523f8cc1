import random

import pytest

from masar.llm import urls as u

SCHEMA = "page_id long, url string, host string, verdict int"


def edge(text, at):
    return not 0 <= at < len(text) or text[at] not in "abcdefghijklmnopqrstuvwxyz0123456789"


def slow(url, strict=u.STRICT, soft=u.SOFT, limit=u.LIMIT):
    """(host, path, rule, verdict, strict hits, soft hits) without an automaton and without regular expressions."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    host = path = ""
    if "://" in low:
        at = low.index("://") + 3
        stop = next((k for k in range(at, len(low)) if low[k] in "/?#"), len(low))
        host, path = low[at:stop], url[stop:]
        path = path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]
    fits = [r for r in u.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len, default=None)
    places = lambda t: [k for k in range(len(low)) if low.startswith(t, k)]
    hard = sorted(t for t in strict if any(edge(low, k - 1) and edge(low, k + len(t)) for k in places(t)))
    some = sorted(t for t in soft if any((all if len(t) < u.SHORT else any)((edge(low, k - 1), edge(low, k + len(t)))) for k in places(t)))
    verdict = u.RULES[rule] if rule else "block" if hard or sum(soft[t] for t in some) >= limit else "allow"
    return host, path, rule, verdict, hard, some


PIECES = ["casino", "win", "spam", "farm", "xxx", "porn", "adult", "cheap", "pills", "é", "example", "sex", "sexy", "track", "ads", "0", "torrents", "dating", "WIN", "Casino"]


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(PIECES) for _ in range(rng.choice([1, 1, 2])))
    rows = [None, "", "://", "no scheme porn", "http://", "http://HOST.Example.ORG/en/1x", "http://example.org/es/a?b#c", "http://a.b.org/x", "http://org/x", "http://forg/x", "http://x.com/fr/adult", "http://x.com/de/", "http://x.com/de", "https://q?x=/p", "http://a://b/c", "http://h.net/viagra", "http://h.net/viagra-viagra", "http://h.net/viagra-poker", "http://porn.net", "http://pornx.net", "http://xporn.net/porn", "x" * 100_000 + " porn"]
    for _ in range(400):
        rows.append(rng.choice(["http://", "HTTPS://", ""]) + rng.choice(["-", ".", "", "_"]).join(word() for _ in range(rng.choice([1, 2, 3]))) + rng.choice([".net", ".com", ".org", ""]) + rng.choice(["", "/", "/de/", "/fr/", "/x"]) + rng.choice(["", word(), "?q=" + word(), "#" + word()]))
    return [(None if k == 7 else k // 2 if k > 300 else k, r, None, 1) for k, r in enumerate(rows)]


def test_against_a_plain_search(spark):
    rows = made()
    got = u.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    have = sorted(str((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], list(r["strict_hits"]), list(r["soft_hits"]))) for r in got)
    assert have == sorted(str((i, *slow(x))) for i, x, *_ in rows)
    found = [slow(x) for _, x, *_ in rows]
    assert any(v == "block" and not r and not hard for _, _, r, v, hard, _ in found) and any(v == "block" and not r and hard for _, _, r, v, hard, _ in found)
    assert all(r["soft_weight"] == sum(u.SOFT[t] for t in r["soft_hits"]) for r in got)


def test_one_soft_term_never_rejects():
    assert all(0 < w < u.LIMIT for w in u.SOFT.values()) and not set(u.STRICT) & set(u.SOFT)
    assert slow("http://h.net/viagra")[3] == "allow" and slow("http://h.net/viagra/viagra")[3] == "allow" and slow("http://h.net/viagra/poker")[3] == "block"


def test_bad_vocabulary(spark):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        u.judge(rows, soft={"casino": 2})
    with pytest.raises(ValueError):
        u.judge(rows, strict=("win",))


def test_empty_table(spark):
    assert u.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_terms_decide_on_pages(spark, sf_dir):
    got = u.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert any(r["rule"] is None and r["verdict"] == "block" for r in got)
    assert sum(r["rule"] is None and r["verdict"] == "block" for r in got) < 0.2 * len(got)
