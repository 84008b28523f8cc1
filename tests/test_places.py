"""Place search on a small town: readings of queries, and what they find."""

import pytest
from pyspark.sql import functions as F

from masar.operators import places as P
from masar.operators import placesearch as S

MAADI, TAHRIR = (29.9602, 31.2569), (30.0444, 31.2357)
CATEGORIES = [
    {"id": "gas_station", "proximity": "local", "terms": {"بنزينه": 1.0, "gas station": 1.0, "fuel": 0.95, "محطه بنزين": 0.95, "محطه": 0.9, "banzeena": 0.9}}, {"id": "pharmacy", "proximity": "walkable", "terms": {"صيدليه": 1.0, "pharmacy": 1.0}}, {"id": "restaurant", "proximity": "local", "terms": {"مطعم": 1.0, "restaurant": 1.0}},
    {"id": "hospital", "proximity": "destination", "terms": {"مستشفي": 1.0, "hospital": 1.0}}, {"id": "mall", "proximity": "destination", "terms": {"مول": 1.0, "mall": 1.0}}, {"id": "square", "proximity": "landmark", "terms": {"ميدان": 1.0, "square": 1.0}},
]
BRANDS = [{"id": "kfc", "category": "fast_food", "names": ["kfc", "كنتاكي"]}, {"id": "master", "category": "gas_station", "names": ["master", "ماستر"]}, {"id": "we", "category": "mobile_shop", "names": ["we"]}]
ENTITIES = [P.Entity("maadi", "المعادي", "maadi", *MAADI, "area", 4000.0, ("el maadi",)), P.Entity("ring", "الطريق الداءري", "ring road", 30.0, 31.3, "road", 3000.0, ("الداءري",)), P.Entity("opera", "دار الاوبرا", "opera house", 30.0426, 31.2244, "landmark", 800.0)]
LEXICON = P.load(CATEGORIES, BRANDS, ENTITIES, intents=(("جعان", "restaurant", 0.8, False),), medicines=frozenset({"بنادول"}), scopes={"along_route": ("علي الطريق", "on the way"), "near_me": ("جنبي",), "near_destination": ("عند الوصول",)}, prepositions=frozenset({"جنب"}), families={"restaurant": ("restaurant", "fast_food")})


def read(q, known=()):
    return P.interpret(q.split(), LEXICON, known)


def test_readings():
    r = read("بنزينه قريبه")
    assert (r["scat"], r["near"], r["residual"]) == ("gas_station", True, [])
    r = read("صيدليه العزبي")
    assert (r["scat"], r["residual"], r["cat_words"]) == ("pharmacy", ["العزبي"], ["صيدليه"])
    r = read("kfc")
    assert (r["brand"], r["brand_scat"], r["residual"], r["beyond"]) == ("kfc", "fast_food", ["kfc"], False)
    assert read("we")["brand"] == "we" and read("we love")["brand"] is None
    r = read("صيدليه جنب المعادي")
    assert r["scat"] == "pharmacy" and r["area"]["name"] == "المعادي" and r["scope"] == "in_area"
    r = read("المعادي")
    assert r["entity"]["id"] == "maadi" and r["area"] is None and ["maadi"] in r["expansions"] and r["residual"] == ["المعادي"]
    assert read("ring road cafe x")["entity"] is None and read("الداءري")["entity"]["kind"] == "road"
    assert read("محطه رمسيس")["typed"] and read("محطه رمسيس")["scat"] is None and read("محطه")["scat"] == "gas_station"
    assert read("ميدان التحرير")["scat"] is None and read("ميدان التحرير")["street"]
    assert read("صيدلبه")["scat"] == "pharmacy" and read("صيدلبه", ["صيدلبه"])["scat"] is None
    assert read("بنادول")["scat"] == "pharmacy" and read("جعان")["scat"] == "restaurant"
    assert read("بنزينه علي الطريق")["scope"] == "along_route" and read("بنزينه جنبي")["near"]
    r = read("صيدليه فاتحه دلوقتي")
    assert r["open_now"] and r["residual"] == []
    assert [w["core"] for w in read("صيدليه في حلوان")["windows"] if w["led"]] == ["حلوان"]
    assert read("")["residual"] == [] and read("the")["residual"] == []


ROWS = []


def place(pid, kind, cat, scat, at, ar, en, *, alt=None, addr=None, brand=None, grp=None, pop=0.3, conf=0.8, ext=0.0):
    ROWS.append((len(ROWS) + 1, pid, kind, cat, scat, *at, ar, en, alt, addr, brand, grp, pop, conf, ext))


def off(p, metres_north, metres_east=0):
    return (p[0] + metres_north / 111_000, p[1] + metres_east / 96_000)


for k in range(15):
    place(f"gas{k}", 0, "gas_station", "gas_station", off(MAADI, 400 * k + 100), f"بنزينة {k}", f"Station {k}", brand="master" if k % 5 == 0 else None)
place("far-gas", 0, "gas_station", "gas_station", off(MAADI, 60_000), "بنزينة بعيدة", "Far Station", pop=1.0)
place("salam", 0, "hospital", "hospital", off(MAADI, 900), "مستشفى السلام الدولي", "As-Salam International Hospital", pop=0.9)
place("salam-ph", 0, "pharmacy", "pharmacy", off(MAADI, 200), "صيدلية السلام", "El Salam Pharmacy")
place("ezaby-m", 0, "pharmacy", "pharmacy", off(MAADI, 300, 200), "صيدلية العزبي", "El Ezaby Pharmacy")
place("ezaby-h", 0, "pharmacy", "pharmacy", (29.8500, 31.3340), "صيدلية العزبي حلوان", "El Ezaby Pharmacy Helwan")
place("ph-h", 0, "pharmacy", "pharmacy", (29.8510, 31.3342), "صيدلية النور", "El Nour Pharmacy")
place("helwan", 1, "town", None, (29.8500, 31.3340), "حلوان", "Helwan", pop=0.8, ext=5000.0)
place("maadi", 1, "neighbourhood", None, off(MAADI, 150), "المعادي", "Maadi", pop=0.9, ext=3000.0)
for k in range(4):
    place(f"kfc{k}", 0, "fast_food", "fast_food", off(MAADI, 700 * k + 50, 300), "كنتاكي", "KFC", brand="kfc")
place("grill", 0, "restaurant", "restaurant", off(MAADI, 120), "مطعم الدهان", "El Dahan Grill", alt="الدهان للمشويات\x1fDahan")
place("tahrir", 2, "square", None, TAHRIR, "ميدان التحرير", "Tahrir Square", pop=0.9)
for k in range(3):
    place(f"9st{k}", 2, "street", None, off(MAADI, 500 * k, 50), "شارع 9", "Street 9", grp="street9", pop=0.2 + k / 10)
place("cilantro1", 0, "cafe", "cafe", off(MAADI, 610), "سيلانترو", "Cilantro", brand="cil")
place("cilantro1b", 0, "cafe", "cafe", off(MAADI, 650), "سيلانترو", "Cilantro", brand="cil", pop=0.2)
place("cilantro2", 0, "cafe", "cafe", off(MAADI, 3000), "سيلانترو", "Cilantro", brand="cil", pop=0.9)
place("cilantro3", 0, "cafe", "cafe", off(MAADI, 9000), "سيلانترو", "Cilantro", brand="cil", pop=0.9)
place("portfouad", 0, "port", None, off(MAADI, 2000), "بورتوفيق", "Port Tawfik")
place("biblio", 0, "library", "library", off(MAADI, 40_000), "مكتبة الإسكندرية", "Bibliotheca Alexandrina", pop=1.0)

QUERIES = {"gas": "بنزينة", "gas-en": "gas station near me", "salam": "مستشفى السلام", "ezaby": "صيدلية العزبي", "in-helwan": "صيدلية في حلوان", "trailing": "صيدلية حلوان", "kfc": "kfc", "kfc-ar": "كنتاكي", "dahan": "el dahan", "dahan-typo": "dahen", "street": "شارع 9", "tahrir": "ميدان التحرير", "maadi": "maadi", "opera": "دار الأوبرا", "chain": "cilantro", "cross": "سيلانترو", "split": "بور توفيق", "nothing": "xyzzyplugh", "empty": "", "prefix": "biblioth", "null": None, "route": "بنزينة على الطريق"}


@pytest.fixture(scope="module")
def found(spark):
    places = spark.createDataFrame(ROWS, S.PLACE)
    route = [off(MAADI, 3000 + 400 * k) for k in range(8)]
    queries = spark.createDataFrame([(k, q, *MAADI, route if k == "route" else None) for k, q in QUERIES.items()], "qid string, q string, lat double, lng double, route array<struct<lat:double,lng:double>>")
    got = S.search(queries, places, LEXICON, limit=6).collect()
    return {k: sorted((r for r in got if r["qid"] == k), key=lambda r: r["rank"]) for k in QUERIES}


def pids(rows):
    return [r["pid"] for r in rows]


def test_a_kind_of_place_nearest_first(found):
    assert pids(found["gas"])[0] == "gas0" and all(r["scat"] == "gas_station" for r in found["gas"]) and len(found["gas"]) == 6
    assert pids(found["gas-en"]) == pids(found["gas"]) and "far-gas" not in pids(found["gas"])
    assert min(r["distance_m"] for r in found["gas"]) < 200


def test_names(found):
    assert pids(found["salam"])[0] == "salam" and found["salam"][0]["kind"] == "cat_name"
    assert pids(found["ezaby"])[0] == "ezaby-m"
    assert pids(found["dahan"])[0] == "grill" and pids(found["dahan-typo"])[0] == "grill"
    assert pids(found["tahrir"])[0] == "tahrir" and pids(found["prefix"])[0] == "biblio"
    assert pids(found["split"])[0] == "portfouad"
    assert found["nothing"] == [] and found["empty"] == [] and found["null"] == []


def test_areas(found):
    for k in ("in-helwan", "trailing"):
        assert {"ezaby-h", "ph-h"} <= set(pids(found[k])) and not {"salam-ph", "ezaby-m"} & set(pids(found[k])), k
    assert pids(found["maadi"])[0] == "maadi"


def test_chains(found):
    assert pids(found["kfc"])[0] == "kfc0" and pids(found["kfc-ar"]) == pids(found["kfc"]) and found["kfc"][0]["kind"] == "brand"
    assert pids(found["chain"])[0] == "cilantro1" and pids(found["cross"])[0] == "cilantro1"
    assert "cilantro1b" not in pids(found["chain"]) and "cilantro2" in pids(found["chain"])  # one within 150 m, others stay


def test_pieces_pins_and_routes(found):
    assert [p for p in pids(found["street"]) if p.startswith("9st")] == ["9st0"]
    assert pids(found["opera"])[0] == "lex:opera"
    assert pids(found["route"])[0] in {f"gas{k}" for k in range(7, 15)}


def test_the_rest(spark):
    places = spark.createDataFrame(ROWS, S.PLACE)
    empty = spark.createDataFrame([], "qid string, q string, lat double, lng double")
    assert S.search(empty, places, LEXICON).collect() == []
    one = spark.createDataFrame([("a", "gas station", *MAADI)], "qid string, q string, lat double, lng double")
    assert S.search(one, spark.createDataFrame([], S.PLACE), LEXICON).collect() == []
    moved = S.refine(spark.createDataFrame([("m", ["المعادي"], 29.95, 31.25, "area"), ("r", ["x"], 0.0, 0.0, "road")], "eid string, names array<string>, lat double, lng double, kind string"), places).collect()
    assert [(r["eid"], round(r["lat"], 4)) for r in moved] == [("m", round(off(MAADI, 150)[0], 4))]
    d = spark.range(1).select(S.brand_family(F.lit("atm"), F.lit("bank")).alias("a"), S.brand_family(F.lit("cafe"), F.lit("bank")).alias("b")).first()
    assert d["a"] and not d["b"]
