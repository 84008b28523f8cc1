import random
import re
from collections import Counter, defaultdict

import numpy as np

from masar.llm import paragraphs as p
from masar.llm.textkit import U, mix, spans, word_hashes

SCHEMA = "doc_id long, text string, node string, bands string"


def words(s):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def word_spans(s):
    """(start, end, word) in code points."""
    return [(m.start(), m.end(), words(m[0])[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", s)]


def hashed(ws):
    raw = np.frombuffer(" ".join(ws).encode(), np.uint8)
    return word_hashes(raw, *spans(raw, np.array([0, len(raw)])))


def cut(ws, least=p.LEAST, reach=p.REACH, piece=p.PIECE):
    """(first word, end word) of each paragraph of a text's words."""
    n = len(ws)
    if not n:
        return []
    if n < least:
        return [(0, n)]
    h = hashed(ws)
    score = [None] + [int(mix(h[i - 1 : i] * U(0x9E3779B97F4A7C15) + h[i : i + 1])[0]) for i in range(1, n)]
    edges = [0]
    for i in range(reach + 1, n - reach):
        if all(score[i] < score[i - k] and score[i] <= score[i + k] for k in range(1, reach + 1)):
            edges.append(i)
    full = []
    for a, b in zip(edges, [*edges[1:], n]):
        full += [a + piece * k for k in range((b - a) // piece)] if b - a >= 2 * piece else [a]
    full.append(n)
    out = {}
    for a in full[:-1]:
        end = next((b for b in full if b - a >= least), None)
        if end:
            out[end] = a  # of paragraphs with one end the shortest
    return sorted((a, b) for b, a in out.items())


def slow(rows):
    """{(id, kind, paragraph, start, end): (origin id, origin paragraph)} of repeated paragraphs, by comparing all pairs."""
    at = []
    for i, t, *_ in rows:
        found, i = word_spans(t or ""), -1 if i is None else i
        ws = [w for _, _, w in found]
        for n, (a, b) in enumerate(cut(ws)):
            at.append(((i, "piece", n, found[a][0], found[b - 1][1]), tuple(ws[a:b])))
        for n, line in enumerate(re.finditer(r"[^\r\n]+", t or "")):
            if len(words(line[0])) >= p.LEAST:
                at.append(((i, "line", n, *line.span()), tuple(words(line[0]))))
    texts = sorted({(kind, w) for (_, kind, *_), w in at})
    sets = [{w[k : k + 5] for k in range(max(len(w) - 4, 1))} for _, w in texts]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s if texts[k][0] == "line" else ():
            holders[x].append(k)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        shared = Counter(b for x in s for b in holders[x] if b < a) if texts[a][0] == "line" else {}
        for b, x in shared.items():
            if x >= 0.8 * (len(s) + len(sets[b]) - x):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    where = {w: k for k, w in enumerate(texts)}
    for place, w in at:
        groups[find(where[place[1], w])].append(place)
    return {x: (min(g)[0], min(g)[2]) for g in groups.values() if len(g) > 1 for x in g}


def data(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["É", "ß"]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    stock = [line(rng.choice([19, 20, 60, 90])) for _ in range(25)]
    rows = []
    for k in range(160):
        out = []
        for _ in range(rng.choice([0, 1, 3, 6])):
            if rng.random() < 0.5:
                w = list(rng.choice(stock))
                if rng.random() < 0.4 and len(w) >= 60:
                    w[rng.randrange(len(w))] = "new"
                out.append("  ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
            else:
                out.append(" ".join(line(rng.choice([5, 30, 80]))))
        rows.append((k, rng.choice(["\n", "\r\n", "\n\n"]).join(out), "x", "y"))
    near = line(80)
    for k in range(60):  # a large group of near copies that share nearly all bands
        w = list(near)
        w[rng.randrange(80)] = f"n{k}"
        rows.append((1000 + k, "😀 head\n" + " ".join(w), None, None))
    rows += [(1500 + k, "Der " * n, "", "") for k, n in enumerate((70, 300, 300, 19, 19, 63))]  # a word over and over
    rows += [(2000, None, "", ""), (2001, "", "", ""), (2002, "\n \n", "", ""), (3, rows[3][1], "", ""), (None, " ".join(stock[1]), "", ""), (2003, "\n".join(" ".join(line(50)) for _ in range(1500)) + "\n" + " ".join(stock[2]), "", "")]
    return rows


def test_equal_to_all_pairs(spark):
    rows = data()
    want = slow(rows)
    for parts in (1, 3):
        got = p.duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        have = {(-1 if r["doc_id"] is None else r["doc_id"], r["kind"], r["paragraph"], r["char_start"], r["char_end"]): (-1 if r["component_id"] is None else r["component_id"], r["component_paragraph"]) for r in got}
        assert have == want
        assert all(r["keep"] == (r["doc_id"] == r["component_id"] and r["paragraph"] == r["component_paragraph"]) for r in got)


def test_cut_texts(spark):
    rows = [r for r in data(2) if r[0] is not None and r[0] != 3]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = p.duplicates(docs)
    gone, stay = defaultdict(list), defaultdict(list)
    for r in found.collect():
        (stay if r["keep"] else gone)[r["doc_id"]].append((r["char_start"], r["char_end"]))
    got = {r["doc_id"]: tuple(r) for r in p.without_duplicates(docs, found).collect()}
    assert len(got) == len(rows) and gone
    for i, t, *rest in rows:
        if t is not None:
            t = "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in gone.get(i, [])) or any(a <= k < b for a, b in stay.get(i, [])))
        assert got[i] == (i, t, *rest)


def test_empty_table(spark):
    assert p.duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bands_reach_the_recall():
    bands, rows = p.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= p.HASHES
    assert p.choose_bands(0.5, 0.9, 64)[1] >= 2


def test_dissimilar_members_of_one_bucket(spark):
    """A bucket whose members are a chain: no leader is similar to all."""
    base = list(range(100))
    sets = [(k, base[k : k + 60]) for k in range(0, 40, 4)] + [(100 + k, [1000 * (k + 1) + j for j in range(60)]) for k in range(30)]
    frame = spark.createDataFrame(sets, "node long, shingles array<long>")
    buckets = spark.createDataFrame([(7, n, len(sets)) for n, _ in sets], "v long, node long, n long")
    from masar.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(p.link(buckets, frame, 0.8)).collect()}
    assert got == {k: 0 for k in range(0, 40, 4)}


def test_passages_inside_and_across_lines(spark):
    """Passages of 51 words and more are caught wherever they stand; texts of their own words aren't."""
    rng = random.Random(5)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, holders = [], {}
    for k in range(300):
        passage = line(rng.choice([51, 55, 60, 80]))
        for copy in range(2):
            ws = line(rng.randrange(5, 200)) + passage + line(rng.randrange(5, 200))
            step = rng.choice([4, 9, 17, 1000])  # lines of so many words, cut without regard to the passage
            rows.append((2 * k + copy, "\n".join(" ".join(ws[a : a + step]) for a in range(0, len(ws), step)), "", ""))
            holders[2 * k + copy] = k
    rows += [(10_000 + k, " ".join(line(300)), "", "") for k in range(300)]
    found = {r["doc_id"] for r in p.duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(found & set(holders)) >= 0.96 * len(holders)
    assert found <= set(holders)


def test_clashing_columns(spark):
    rows = [r for r in data(4) if r[0] is not None and r[0] != 3][:80]
    docs = spark.createDataFrame(rows, SCHEMA)
    for extra in ("cut_key", "cuts", "key", "kind", "node", "component", "keep", "k", "Char_Start"):
        docs = docs.withColumn(extra, docs.doc_id % 7)
    found = p.duplicates(docs)
    plain = p.duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert p.without_duplicates(docs, found).columns == docs.columns and p.without_duplicates(docs, found).count() == len(rows)
