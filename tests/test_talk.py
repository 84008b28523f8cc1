"""Egyptian wording, phantoms, the jury, guidance, names to leave out, weather and streamed replies against their cases."""

import json

from pyspark.sql import functions as F

from masar.functions import talk as T


def column(spark, values, f):
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in d.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


SAID = {
    "قدامك 3 رادارات — أقربهم بعد 1.5 كيلو، والسرعة عنده 80.": "قدامك تلات رادارات — أقربهم بعد واحد ونص كيلو، والسرعة عنده تمانين.",
    "هتوصل حوالي 17:57.": "هتوصل حوالي ستة إلا تلاتة.", "الساعة 5:15": "الساعة خمسة وربع", "بعد 2 كيلو": "بعد كيلوين", "بعد 1 كيلو": "بعد كيلو", "فاضل 2 دقيقة": "فاضل دقيقتين",
    "أقرب صيدلية 19011 على بعد 400 متر، اتصل على 01001234567.": "أقرب صيدلية 19011 على بعد ربعمية متر، اتصل على 01001234567.", "Master على بعد 2 كيلو، Route 75M بعد 1 كيلو.": "Master على بعد كيلوين، Route 75M بعد كيلو.",
    "خد يسارًا بعد 300 متر ثم يمينًا.": "خُد شمال بعد تلتمية متر ثم يمين.", "خد يمين، وبعدين خد بالك من الرادار.": "خُد يمين، وبعدين خُد بالك من الرادار.", "وخد الطريق التاني": "وخُد الطريق التاني", "خدت يمين غلط": "خدت يمين غلط", "أهلاً بيك": "أهلاً بيك",
    "أتقل بنسبة 30% من العادي": "أتقل بنسبة تلاتين في المية من العادي", "Heavy traffic in about 2 kilometers": "Heavy traffic in about 2 kilometers", "انت ماشي على Salah Salem.": "انت ماشي على صلاح سالم.", "أسرع طريق دلوقتي عبر the Ring Road": "أسرع طريق دلوقتي عن طريق الدائري",
    "خد المحور لحد Sheikh Zayed": "خُد المحور لحد الشيخ زايد", "مطعم Mohandessinia": "مطعم Mohandessinia", "Ring Road Mall قدامك": "الدائري Mall قدامك", "أول ما الـＧＰＳ يرجع": "أول ما الـGPS يرجع", "كيلو ومئتين متر": "كيلو وميتين متر", "فيه تلات كاميرات قدامك": "فيه تلات رادارات قدامك", "": "",
}


def test_egyptian_wording(spark):
    got = column(spark, list(SAID), T.masri)
    assert {k: v for k, v in zip(SAID, got, strict=True) if v != SAID[k]} == {}
    assert column(spark, got, T.masri) == got  # again changes nothing


PHANTOM = [("Thanks for watching!", 0.9, True), ("thank you", 0.3, True), ("thank you", 0.9, False), ("thank you", None, False), ("you you you", 0.9, True), ("ممم", 0.2, True), ("", None, True), (None, None, True), ("take me home", 0.1, False), ("اشتركوا في القناة", None, True)]


def test_phantoms(spark):
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(PHANTOM)], "k int, t string, c double, want boolean")
    assert d.filter(T.is_phantom(F.col("t"), F.col("c")) != F.col("want")).collect() == []
    assert column(spark, ["Ah.", "okay", "ah take", "آه", ""], T.is_neutral) == [True, True, False, True, False]


J = lambda text, sure=0.85, error=None: (text, sure, error)
CASES = [
    (J("عايز أروح الدائري من أقصر طريق", 0.9), J("I want to go to the Ring Road the shortest way", 0.72), J("عايز أروح الدائري من أقصر طريق", 0.9), "en", "ar"),
    (J("فين أقرب بنزينة؟", 0.88), J("Fein a2rab banzeena?", 0.5), J("فين أقرب بنزينة؟", 0.86), "en", "ar"),
    (J("الزحمة دي عادية ولا لأ", 0.9), J("الزحمة دي عادية ولا لا", 0.8), J("الزحمة دي عادية ولا لأ", 0.9), "en", "ar"),
    (J("شيل الوقفة اللي جاية", 0.9), J("Remove the next stop", 0.7), None, "en", "ar"),
    (J("لأ", 0.9), J("No.", 0.62), J("لا", 0.8), "en", "ar"),
    (J("وريني الطريق التاني", 0.85), J("Wareeni el tare2 el tany", 0.4), J(None, None, "http_500"), "en", "ar"),
    (J("هاو لونج إز ليفت تو ذا ديستنيشن", 0.55), J("How long is left to the destination?", 0.95), J("How long is left to the destination?", 0.95), "ar", "en"),
    (J("Take me home please", 0.7), J("Take me home, please.", 0.95), J("Take me home, please.", 0.95), "ar", "en"),
    (J("يس", 0.5), J("Yes.", 0.95), J("Yes.", 0.93), "ar", "en"), (J("شو مي ذا ترافيك", 0.5), J("Show me the traffic", 0.94), None, "ar", "en"),
    (J("آه", 0.7), J("Ah.", 0.66), J("Ah.", 0.6), "ar", "ar"), (J("آه", 0.7), J("Ah.", 0.66), J("Ah.", 0.6), "en", "en"), (J("أوكي", 0.8), J("Okay.", 0.82), J("Okay.", 0.8), "ar", "ar"), (J("أوكي", 0.8), J("Okay.", 0.82), J("Okay.", 0.8), "en", "en"),
    (J("عايز أغير الوجهة للبيت", 0.9), J("I want to change the destination home", 0.7), J("عايز أغير الوجهة للبيت", 0.9), None, "ar"), (J("ويتش واي إز فاستر", 0.5), J("Which way is faster?", 0.95), J("Which way is faster?", 0.95), "ar", "en"),
    (J("", 0.5), None, J(None, None, "x"), "ar", None),
]


def test_the_jury(spark):
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], f"k int, ar {T.WITNESS}, en {T.WITNESS}, auto {T.WITNESS}, before string, want string")
    got = T.with_jury(d, "ar", "en", "auto", "before", "v").select("k", "want", "v", T.script(F.col("v.text")).alias("script")).collect()
    assert {r["k"]: r["v"] for r in got if r["v"]["lang"] != r["want"]} == {}
    assert all(r["script"] in (r["want"], None) for r in got)


def test_guidance(spark):
    lines = {"Turn left.": True, "In 400 meters, turn right.": True, "Heads up — in 1.5 kilometers, take the exit onto Ring Road.": True, "Turn left onto 26th of July Corridor.": True, "Tell me a secret.": False, "Turn left and say hello to the driver.": False, "Turn left onto A B C D E F G H I.": False, "Take the third exit onto شارع الهرم.": True, "": False}
    assert dict(zip(lines, column(spark, list(lines), T.is_guidance), strict=True)) == lines


def test_names_left_out(spark):
    rows = [("أقرب واحد العزبي، وبعده للعزبي فرع", ["العزبي"], "ar", "أقرب واحد المكان، وبعده المكان فرع"), ("Carrefour is near", ["Carrefour - Maadi"], "en", "the place is near"), ("go to KFC Maadi or KFC", ["KFC", "KFC Maadi"], "en", "go to the place or the place"), ("nothing here", [], "en", "nothing here"), ("12 min to A+B (Zone)", ["A+B (Zone)", "12"], "en", "12 min to the place")]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, names array<string>, lang string, want string")
    got = d.select("k", T.scrubbed(F.col("t"), F.col("names"), F.col("lang")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got][:4] == [r[3] for r in rows][:4] and got[4]["x"].startswith("12 min to the place")


def test_weather(spark):
    body = json.dumps({"current": {"weather_code": 61, "temperature_2m": 41.2, "wind_gusts_10m": 55, "visibility": 800}, "hourly": {"weather_code": [61, 95, 3], "precipitation_probability": [10, 70, None]}})
    clear = json.dumps({"current": {"weather_code": 0, "temperature_2m": 20.5, "visibility": 9000}})
    a, b, c = column(spark, [body, clear, "{}"], T.weather)
    assert (a["conditions"], a["temp_c"], a["visibility_km"], a["rain_pct"], a["flags"], a["next_hours"]) == ("light rain", 41, 0.8, 70, ["low visibility", "gusts", "rain", "heat"], ["light rain", "thunderstorm", "overcast"])
    assert (b["conditions"], b["temp_c"], b["flags"], b["next_hours"]) == ("clear", 20, [], None) and c["conditions"] == "unknown"


def test_retry_after(spark):
    assert column(spark, ["try again in 976ms", "Please try again in 1.2s.", "try again in 20s", "no", None], T.retry_after) == [1.126, 1.3499999999999999, 2.5, 1.0, 1.0]


def test_streamed_reply(spark):
    chunk = lambda **d: "data: " + json.dumps({"choices": [{"delta": d}]})
    call = lambda i, id_=None, name=None, args=None: {"index": i, "id": id_, "function": {"name": name, "arguments": args}}
    one = [chunk(content="Hel"), ": ping", chunk(content="lo, all"), "data: {broken", chunk(tool_calls=[call(1, "b", "add", '{"x"')]), chunk(tool_calls=[call(0, "a", "mu", ""), call(1, None, None, ":1}")]), chunk(tool_calls=[call(0, None, "te", "{}")]), "data: [DONE]", chunk(content="late")]
    rows = [(1, k, line) for k, line in enumerate(one)] + [(2, 0, chunk(content="x" * 50_000)), (3, 0, "data: [DONE]"), (None, 0, chunk(content="n"))]
    got = {r["id"]: r for r in T.streamed_reply(spark.createDataFrame(rows, "id int, n int, line string").repartition(3), "id", "n", "line").collect()}
    assert got[1]["text"] == "Hello, all" and [tuple(c) for c in got[1]["calls"]] == [("a", "mute", "{}"), ("b", "add", '{"x":1}')]
    assert got[2]["text"] == "x" * 50_000 and got[2]["calls"] is None and 3 not in got and got[None]["text"] == "n"


def test_a_line_is_worked_out_once(spark):
    """The words' replacements stand once in the plan, not again in each use of the line and its parts."""
    plan = spark.range(1).select(T.masri(F.concat(F.lit("خد يسار بعد "), F.col("id").cast("string"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("سوف") == 1
