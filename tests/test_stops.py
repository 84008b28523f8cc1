"""Stops: kinds, names, decisions, alternatives, messages, and the monitor of trips."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from masar.functions import stops as S
from masar.operators import monitor


def column(spark, values, f):
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in d.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_kinds_and_types(spark):
    brands = {"Master station": "fuel", "ماستر": "fuel", "KFC Maadi": "restaurant", "صيدلية العزبي": "pharmacy", "nobody": None, None: None}
    assert column(spark, list(brands), S.brand_kind) == list(brands.values())
    generic = {"the nearest gas station": "fuel", "أقرب بنزينة": "fuel", "ATM": "atm", "Master": None, "coffee": "cafe"}
    assert column(spark, list(generic), S.generic_kind) == list(generic.values())
    types = {"Master": "gas_station", "best coffee shop": "cafe", "مستشفى": "hospital", "somewhere fun": None, "a quiet cafe please": "cafe", "playstation": "video_arcade", "xyz": None}
    assert column(spark, list(types), S.place_type) == list(types.values())


def test_names_and_decisions(spark):
    rows = [("ماستر", "Master Gas", "strong"), ("small ring", "big ring", "strong"), ("Cilantro", "Cilantro Zamalek", "strong"), ("blue box", "red car", "weak"), ("", "x", "strong")]
    d = spark.createDataFrame(rows, "a string, b string, want string")
    assert d.filter(S.name_match(F.col("a"), F.col("b")) != F.col("want")).collect() == []
    cases = [("stop", None, "x", 1, 1.0, "ask"), (None, None, "x", 1, 1.0, "ask"), ("Master", None, None, None, None, "none"), ("Master", None, "Master", 5, 3.0, "auto"), ("Master", None, "Master", 9, 3.0, "confirm"), ("Master", None, "Other", 5, 3.0, "confirm"), ("Master", None, "Master", None, 3.0, "confirm"), ("Master", None, "Master", 300, 3.0, "too_far"), (None, "pharmacy", "X", 4, 90.0, "too_far"), ("gas station", None, "Any", 4, 1.0, "auto"), (None, "something odd", "Any", 4, 1.0, "confirm"), ("وقفة", None, "x", 1, 1.0, "ask")]
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, name string, asked string, found string, mins int, km double, want string")
    got = d.select("k", "want", S.stop_decision(F.col("name"), F.col("asked"), F.col("found"), F.col("mins"), F.col("km")).alias("x")).filter("x != want or x is null").collect()
    assert got == []
    assert [r["x"] for r in spark.createDataFrame([(0, 600.0, 300.0), (1, 100.0, 300.0), (2, None, 1.0)], "k int, v double, b double").select("k", S.added_minutes(F.col("v"), F.col("b")).alias("x")).orderBy("k").collect()] == [5, 0, None]


def test_removing_and_switching(spark):
    cases = [(["Master", "KFC"], "master", False, (True, "Master")), (["Master", "Master 2"], "master", False, (False, None)), (["KFC"], "pharmacy", False, (True, "KFC")), (["KFC", "X"], None, False, (False, None)), (["KFC"], None, False, (True, "KFC")), ([], "x", False, (False, None)), (["a", "b"], None, True, (True, None)), (["KFC", "X"], "zzz", False, (False, None))]
    d = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, stops array<string>, t string, every boolean")
    assert [tuple(r["x"]) for r in d.select("k", S.removed_stop(F.col("stops"), F.col("t"), F.col("every")).alias("x")).orderBy("k").collect()] == [c[3] for c in cases]
    alts = [(1, "Ring Road", 4), (2, "Salah Salem, Autostrad", -3), (3, "Ring Road, Mehwar", -1)]
    d = spark.createDataFrame([(0, "the salah road", alts), (1, "ring road", alts), (2, "road", alts), (3, "x", []), (4, "Mehwar", alts[:1])], "k int, road string, alts array<struct<index:int,via:string,delta:int>>")
    got = d.select("k", S.matching_alternative(F.col("road"), F.col("alts")).alias("m"), S.fastest_alternative(F.col("alts")).alias("f")).orderBy("k").collect()
    assert [(r["m"], r["f"]) for r in got] == [(2, 2), (None, 2), (None, 2), (None, None), (None, None)]


def test_messages(spark):
    d = spark.createDataFrame([(0, "improvement", "FREE", 2, 9, None), (1, "improvement", "WARNING", 7, 9, None), (2, "escalation", "SERIOUS", 20, 9, None), (3, "new", "CRITICAL", 25, None, 12.7), (4, "new", "WARNING", 6, None, 1.0)], "k int, kind string, level string, delay int, b int, lead double")
    got = [tuple(r["m"]) for r in d.select("k", S.notification(F.col("kind"), F.col("level"), F.col("delay"), F.col("b"), F.col("lead"), F.lit(10), F.lit("Home")).alias("m")).orderBy("k").collect()]
    assert got[0][0] == "Road's clearing up for Home ✨" and "(was +9)" in got[1][1] and "up from +9" in got[2][1] and "hits about 12 min" in got[3][1] and "slow stretch" not in got[4][1] and "6 extra minutes" in got[4][1]


def test_the_monitor(spark):
    t = datetime(2026, 1, 1, 8)
    m = lambda k: t + timedelta(minutes=k)
    trips = spark.createDataFrame([("a", "active", m(40)), ("b", "active", m(25)), ("c", "done", m(20)), ("d", "active", m(300)), ("e", "active", m(10))], "trip string, status string, departure timestamp")
    scans = spark.createDataFrame([("a", m(0), False, 0.0), ("a", m(30), False, 1.0), ("b", m(0), True, 12.0), ("b", m(15), True, 3.0), ("e", m(0), True, 30.0)], "trip string, at timestamp, should_alert boolean, delay double")
    ticks = spark.createDataFrame([(m(15 * k),) for k in range(4)], "tick timestamp")
    got = sorted(((r["tick"] - t).seconds // 60, r["trip"], r["sent"]) for r in monitor.monitored(trips, scans, ticks).collect())
    assert got == [(0, "a", "scan"), (0, "b", "alert"), (0, "e", "alert"), (15, "b", "scan"), (30, "a", "all_clear"), (30, "a", "scan")]
