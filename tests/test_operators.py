"""Golden values, plain specifications and replays of what SQL can't express."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from masar.functions import codecs as C
from masar.functions import levels as L
from masar.functions import speech as Z
from masar.functions import text as X
from masar.functions import times as T
from masar.operators import admission as A
from masar.operators import graph as GR
from masar.operators import neural as N
from masar.operators import plans as P
from masar.operators import routes as O
from masar.operators import search as S
from masar.sources import connectors, sinks
from masar.streaming import stateful


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def test_normaliser(spark):
    cases = {"Straße ÉCOLE": "strasse ecole", "مُحَمَّد": "محمد", "أحمد إلى آخر": "احمد الي اخر", "شارع٩": "شارع 9", "a-b,c": "a b c", None: "", "مدرسة": "مدرسه", "هيئة": "هييه", "٣ ابراج": "3 ابراج"}
    assert column(spark, list(cases), "string", X.normalize) == list(cases.values())


def test_stems_and_loose_forms(spark):
    stems = {"والقاهره": "قاهره", "القاهره": "قاهره", "الف": None, "elmaadi": "maadi", "alex": None, "el": None, "alexandria": None}
    assert column(spark, list(stems), "string", X.stem) == list(stems.values())
    loose = {"abou": "ab", "بيشوي": "بش", "الحاج": "حج", "hello": "hl"}
    assert column(spark, list(loose), "string", X.loose) == list(loose.values())


def test_edit_distance(spark):
    assert S.osa_distance("abcd", "abdc", 2) == 1 and S.osa_distance("ca", "abc", 3) == 3 and S.osa_distance("same", "same", 1) == 0
    assert S.osa_distance("abc", "xyz", 1) == 2 and S.osa_distance("", "ab", 2) == 2 and S.osa_distance(None, "a", 1) is None
    assert column(spark, ["maadi", "madai", None], "string", lambda x: S.osa(x, F.lit("maadi"), 2)) == [0, 1, None]


def test_arabizi_and_requests(spark):
    cases = {"3ayez aro7 beit": True, "take me home": False, "yalla bina": True, "2nd street at 8am, 5km": False, "za7ma": True, "": False}
    assert column(spark, list(cases), "string", Z.is_arabizi) == list(cases.values())
    asks = {"please speak english": "en", "بالعربي": "ar", "كلمني انجليزي": "en", "hi": None}
    assert column(spark, list(asks), "string", Z.asked_language) == list(asks.values())


def test_sentences_keep_decimals(spark):
    assert column(spark, ["It is 3.5 km. Go! Now? أهلا؟ نعم", ""], "string", X.sentences) == [["It is 3.5 km.", "Go!", "Now?", "أهلا؟", "نعم"], []]


def test_six_digits(spark):
    assert column(spark, [30.0, 30.123456, -0.0000001, 31.5], "double", X.six_digits) == ["30", "30.123456", "0", "31.5"]


def test_floors_cascade(spark):
    rows = spark.createDataFrame([("CRITICAL", 3), ("CRITICAL", 12), ("CRITICAL", 18), ("SERIOUS", 9), ("WARNING", 5)], "l string, d int")
    assert [r[0] for r in rows.select(L.with_floors(F.col("l"), F.col("d"))).collect()] == ["ADVISORY", "SERIOUS", "CRITICAL", "WARNING", "WARNING"]


def test_cairo_summer_time(spark):
    rows = spark.createDataFrame([("2026-07-01 10:00:00",), ("2026-01-01 10:00:00",)], "t string").select(F.hour(T.cairo(F.to_timestamp("t"))))
    assert [r[0] for r in rows.collect()] == [13, 12]


def test_prayers_of_a_printed_calendar(spark):
    """Cairo, 1 January 2026 (winter time) and 21 June 2026 (summer time), to two minutes."""
    printed = {"2026-01-01": (2.0, {"fajr": "5:18", "sunrise": "6:51", "dhuhr": "11:59", "asr": "14:47", "maghrib": "17:06", "isha": "18:29"}), "2026-06-21": (3.0, {"fajr": "4:08", "sunrise": "5:54", "dhuhr": "12:57", "asr": "16:33", "maghrib": "19:59", "isha": "21:33"})}
    for day, (offset, want) in printed.items():
        got = spark.createDataFrame([(day,)], "d string").select(*P.prayer_columns(F.to_date("d"), F.lit(30.0444), F.lit(31.2357), F.lit(offset))).first().asDict()
        for name, clock in want.items():
            h, m = map(int, clock.split(":"))
            assert abs(got[name] * 60 - (h * 60 + m)) <= 2.5, (day, name, got[name])


def test_fold_of_a_route(spark):
    rng = random.Random(3)
    curves = [[rng.random() for _ in range(168)] for _ in range(6)]
    elapsed = jam = 0.0
    for c in curves:
        j = c[3 * 24 + int((17 * 3600 + elapsed + 600) // 3600) % 24]
        jam, elapsed = jam + j, elapsed + 1200 * (1 + 1.5 * j)
    got = spark.createDataFrame([(curves,)], "c array<array<double>>").select(P.tier1(F.col("c"), F.lit(17), F.lit(3), F.lit(7200.0)).alias("f")).first()["f"]
    assert got["elapsed"] == pytest.approx(elapsed) and got["jam"] == pytest.approx(jam / 6)


def test_gaps(spark):
    assert column(spark, [[0.0, 1.0, 1.5, 2.9, 3.1], []], "array<double>", lambda x: O.keep_by_gap(x, 1.5)) == [[0.0, 1.5, 3.1], []]


def test_shortest_paths(spark):
    import heapq

    rng = random.Random(7)
    edges = [(rng.randrange(40), rng.randrange(40), rng.uniform(10, 100)) for _ in range(220)]
    best, heap = {}, [(0.0, 0)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in best or d > 250:
            continue
        best[n] = d
        for s, t, w in edges:
            if t == n:
                heapq.heappush(heap, (d + w, s))
    got = {r["node"]: r["sec"] for r in GR.bounded_reverse(spark.createDataFrame(edges, "src long, dst long, sec double"), 0, 250.0).collect()}
    assert got.keys() == best.keys() and all(got[k] == pytest.approx(v) for k, v in best.items())


def decisions():
    rng = random.Random(5)
    return [(k, rng.randrange(6), k, f"2024-01-{1 + k // 150:02d}", rng.randrange(40), rng.choice(A.LEVELS), rng.randrange(40)) for k in range(600)]


SCHEMA = "id long, user long, t long, day string, amount int, level string, delay int"
STEPS = [(A.quota(60), ["day", "amount"], "boolean"), (A.token_bucket(1.0, 3), ["t"], "boolean"), (A.fixed_window(80, 60), ["t", "amount"], "boolean"), (A.alerts(), ["level", "delay"], "string"), (A.lru(50), ["level", "amount"], "boolean")]


@pytest.mark.parametrize("step, inputs, kind", STEPS)
def test_batch_fold_is_the_plain_loop(spark, step, inputs, kind):
    rows, names = decisions(), [c.split()[0] for c in SCHEMA.split(", ")]
    states, want = {}, {}
    for r in rows:
        d = dict(zip(names, r, strict=True))
        states[d["user"]], want[d["id"]] = step(states.get(d["user"]), tuple(d[i] for i in inputs))
    got = A.fold(spark.createDataFrame(rows, SCHEMA).repartition(3), "user", ["t"], inputs, step, "id", "out", kind).collect()
    assert {r["id"]: r["out"] for r in got} == want


def test_stream_is_the_batch(spark, tmp_path):
    rows = decisions()
    for k in range(3):
        spark.createDataFrame(rows[k * 200 : (k + 1) * 200], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    step, inputs, kind = STEPS[0]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = stateful.fold_stream(stream, "user", ["t"], inputs, step, "id", "out", kind)
    q = out.writeStream.format("memory").queryName("quota_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["id"]: r["out"] for r in A.fold(spark.createDataFrame(rows, SCHEMA), "user", ["t"], inputs, step, "id", "out", kind).collect()}
    assert {r["id"]: r["out"] for r in spark.sql("select * from quota_out").collect()} == want


def test_polylines():
    assert C.read_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert C.write_polyline([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert C.read_polyline("_p~iF~ps|U_ulL") == [(38.5, -120.2)] and C.read_polyline(None) == []
    points = [(30.0444123, 31.2357456), (-30.5, -31.25)]
    assert C.read_polyline(C.write_polyline(points, 6), 6) == [(30.044412, 31.235746), (-30.5, -31.25)]


def test_vector_tile():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    feature = field(2, bytes([0, 0])) + bytes([3 << 3, 2]) + field(4, bytes([9, 50, 34, 18, 2, 2, 4, 1]))
    layer = field(1, b"traffic") + field(2, feature) + field(3, b"congestion") + field(4, field(1, b"heavy"))
    assert C.read_tile(field(3, layer)) == [("traffic", {"congestion": "heavy"}, [[(25, 17), (26, 18), (28, 17)]])]
    assert C.read_tile(None) == []


def test_wav():
    head = b"RIFF" + struct.pack("<I", 36 + 800) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 400, 400, 1, 8)
    assert C.wav_seconds(head + b"data" + struct.pack("<I", 800) + bytes(800)) == 2.0
    assert C.wav_seconds(head + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 400) + bytes(400)) == 1.0
    assert C.wav_seconds(b"") is None and C.wav_seconds(b"RIFFxxxxWAVE") is None


def test_inference_is_in_range():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(5, N.STEPS, N.FEATURES))
    jam, level = N.infer(x, N.seeded())
    assert jam.shape == (5, 3) and (jam > 0).all() and (jam < 1).all() and np.allclose(level.sum(axis=1), 1)
    mixed, _ = N.infer(x, N.seeded(), N.normalised(np.ones((5, 5)) - np.eye(5)))
    assert np.allclose(mixed, mixed[:1])  # a complete graph makes all nodes alike


def test_paged_source(spark, tmp_path):
    for page in range(3):
        (tmp_path / f"p{page}.json").write_text(json.dumps([{"id": page * 10 + k, "is_active": k % 2 == 0} for k in range(5)]))
    connectors.register(spark)
    df = spark.read.format("paged_table").schema("id long, is_active boolean").option("url", f"file://{tmp_path}/p{{page}}.json").option("pages", 3).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r[0] for r in df.filter("is_active = true").select("id").collect()) == [0, 2, 4, 10, 12, 14, 20, 22, 24]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "j.csv").write_text("junction_id,latitude,longitude,governorate,ways_count,tier,junction_idx\nJ_0001,30.1,31.2,Cairo,4,1,0\n")
    real = connectors.junctions(spark, str(tmp_path / "j.csv"))
    assert connectors.combined(spark, None, real).first().asDict()["junction_type"] == "real"
    assert dict(real.dtypes)["latitude"] == "double"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, day string, v int")
    sinks.append(rows, path, "day")
    sinks.rewrite_partitions(spark.createDataFrame([(3, "b", 2)], "id int, day string, v int"), path, "day")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 3]
    new = spark.createDataFrame([(2, "b", 1), (4, "c", 1)], "id int, day string, v int")
    assert sorted(r["id"] for r in sinks.upserted(rows, new, "id", "v").collect()) == [1, 2, 4]
    assert json.loads(sinks.lines(rows, "slot").first()[0])["type"] == "slot"


def test_graph_convolution_by_hand(spark):
    """Two nodes joined by an edge of weight 1: each layer mixes halves, and a node of noughts still gets its neighbour's."""
    w = N.seeded(3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, N.STEPS, N.FEATURES))

    def by_hand(x):
        for m in w.conv:
            y = x @ m
            x = np.maximum(np.stack([(y[0] + y[1]) / 2, (y[0] + y[1]) / 2]), 0)
        return x

    same, _ = N.infer(x, w, N.normalised(np.array([[0.0, 1.0], [1.0, 0.0]])))
    plain = N.Weights((np.eye(N.EMBEDDED),) * 2, w.lstm, w.jam, w.level)
    alone, _ = N.infer(by_hand(x), plain)
    assert np.allclose(same, alone) and w.conv[0].shape == (16, 64) and w.conv[1].shape == (64, 32) and [m.shape for m, _ in w.jam] == [(128, 256), (256, 128), (128, 3)]
    d = spark.createDataFrame([("g", 0, x[0].ravel().tolist()), ("g", 1, x[1].ravel().tolist()), ("h", 1, x[1].ravel().tolist()), ("h", 0, [0.0])], "g string, n int, w array<double>")
    got = {(r["g"], r["n"]): r["jam_15"] for r in N.predict_graphs(d, "g", "n", "w", w, {(0, 1): 1.0, (1, 0): 1.0}, 2).collect()}
    assert set(got) == {("g", 0), ("g", 1), ("h", 1)} and np.isclose(got["g", 0], same[0, 0])
    half, _ = N.infer(np.stack([np.zeros_like(x[1]), x[1]]), w, N.normalised(np.array([[0.0, 1.0], [1.0, 0.0]])))
    assert np.isclose(got["h", 1], half[1, 0])


def test_nearest_k_by_rings(spark):
    from masar.operators import routes as O

    rng = np.random.default_rng(2)
    sites = [(k, 30 + float(a), 31 + float(b)) for k, (a, b) in enumerate(rng.normal(0, 0.05, (120, 2)))] + [(1000, 30.6, 31.6)]
    d = spark.createDataFrame(sites, "s long, lat double, lng double")
    got = {}
    for r in O.nearest_k(d, "s", 4, 60.0).collect():
        got.setdefault(r["s"], []).append((r["n"], r["other"]))

    def km(a, b):
        p, q = np.radians(a[1]), np.radians(b[1])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * np.arcsin(np.sqrt(h))

    for a in sites:
        near = sorted((km(a, b), b[0]) for b in sites if b[0] != a[0] and km(a, b) <= 60)[:4]
        assert [o for _, o in sorted(got.get(a[0], []))] == [o for _, o in near]


def test_null_keys_keep_their_state(spark):
    from masar.operators import admission as A

    rows = spark.createDataFrame([(None, k, float(k) / 100) for k in range(6)] + [(5, k, float(k) / 100) for k in range(6)], "key long, id int, t double")
    got = A.fold(rows, "key", ["t"], ["t"], A.token_bucket(1.0, 2.0), "id", "ok", "boolean").collect()
    assert sum(r["ok"] for r in got if r["key"] is None) == 2 == sum(r["ok"] for r in got if r["key"] == 5)


def test_nearest_sites_by_rings(spark):
    """As brute force has them: points and sites at one place, ties, no place, and nothing near."""
    from masar.functions import geo as G

    r = random.Random(5)
    points = [(k, 29.85 + r.randrange(40) / 100, 31.0 + r.randrange(60) / 100) for k in range(60)] + [(60, 30.0, 31.2), (61, 30.0, 31.2), (62, None, None), (63, 33.0, 35.0)]
    sites = [(k, 29.85 + r.randrange(40) / 100, 31.0 + r.randrange(60) / 100) for k in range(300)] + [(300 + k, 30.0, 31.2) for k in range(30)] + [(330, None, 31.0)]
    p, s = spark.createDataFrame(points, "p int, lat double, lng double"), spark.createDataFrame(sites, "s int, lat double, lng double")
    pairs = spark.createDataFrame([(a[0], b[0], *a[1:], *b[1:]) for a in points for b in sites], "p int, s int, a double, b double, c double, d double").select("p", "s", G.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).filter("km <= 8").collect()
    for k in (1, 20):
        want = {}
        for x in sorted(pairs, key=lambda x: (x["km"], x["s"])):
            want.setdefault(x["p"], []).append(x["s"])
        got = {}
        rows = O.nearest_sites(p, s, "p", "s", k, 8.0).collect()
        for x in sorted(rows, key=lambda x: x["n"]):
            got.setdefault(x["p"], []).append(x["s"])
        assert got == {x: v[:k] for x, v in want.items()} and 63 not in got and got[60] == got[61]
    assert O.nearest_sites(p, s.limit(0), "p", "s", 3, 8.0).collect() == []


def test_best_departures_are_the_plans(spark):
    """Routes folded by the hour, a batch at a time, give what the plan's 76 rows give: no points, unknown junctions, anchors or none."""
    from masar.operators import trips as T

    r = random.Random(3)
    curves = spark.createDataFrame([(k, [r.random() for _ in range(168)]) for k in range(8)], "junction long, curve array<double>")
    rows = [(k, [r.randrange(8) for _ in range(r.randrange(1, 7))], 900 + 37 * k, k % 7, 0.9 if k % 3 == 0 else 0.2, [(r.randrange(280, 1500), r.randrange(900, 4000)) for _ in range(1 + k % 4)] if k % 2 else None) for k in range(40)]
    rows[5] = (5, [], 1000, 1, 0.1, [(720, 900)])
    rows[6] = (6, [], 1000, 1, 0.9, None)
    routes = spark.createDataFrame(rows, "route long, junctions array<long>, base int, dow int, coverage double, anchors array<struct<minute:int,seconds:int>>")
    anchors = routes.select("route", F.explode("anchors").alias("a")).select("route", "a.*")
    table = {x["junction"]: x["curve"] for x in curves.collect()}
    full = spark.createDataFrame([(k, [table[j] for j in js], base, dow, coverage) for k, js, base, dow, coverage, _ in rows], "route long, curves array<array<double>>, base int, dow int, coverage double")
    want = {}
    for x in T.plan(full, anchors).collect():
        want.setdefault(x["route"], []).append(x)
    odd = routes.withColumn("junctions", F.concat(F.array(F.lit(99).cast("long")), "junctions"))  # an unknown one counts for nothing
    for given in (routes, odd):
        got = {x["route"]: x for x in T.best_departures(given, curves).collect()}
        assert set(got) == set(want)
        for k, xs in want.items():
            g = got[k]
            assert (g["source"], g["best_slot"], g["best_seconds"], g["worst_seconds"], g["slots"]) == (xs[0]["source"], next(x["slot"] for x in xs if x["recommended"]), min(x["seconds"] for x in xs), max(x["seconds"] for x in xs), 76)
            assert np.isclose(g["confidence"], sum(x["confidence"] for x in xs))
