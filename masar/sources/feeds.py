"""Feeds of providers: answers read as rows, and requests fanned out over tasks with retries, slots and caches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masar.functions import text as X
from masar.functions.levels import clamp

# The departures asked for in a day, as hours and minutes, and those of the week's classes of days.
PLAN_SLOTS = ((5, 0), (6, 0), (7, 0), (7, 30), (8, 0), (8, 15), (8, 30), (8, 45), (9, 0), (9, 30), (10, 0), (11, 0), (12, 0), (13, 0), (14, 0), (15, 0), (16, 0), (16, 30), (17, 0), (17, 15), (17, 30), (17, 45), (18, 0), (18, 30), (19, 0), (20, 0), (21, 0))
WEEKDAY = ((5, 0), (6, 0), (7, 0), (7, 30), (8, 0), (8, 30), (9, 0), (9, 30), (10, 0), (11, 0), (12, 0), (13, 0), (14, 0), (15, 0), (16, 0), (17, 0), (17, 30), (18, 0), (19, 0), (21, 0))
FRIDAY = ((6, 0), (8, 0), (9, 0), (10, 0), (11, 0), (12, 0), (12, 30), (13, 0), (13, 30), (14, 0), (15, 0), (16, 0), (17, 0), (17, 30), (18, 0), (19, 0), (20, 0), (21, 0), (22, 0), (23, 0))
SATURDAY = ((6, 0), (8, 0), (9, 0), (10, 0), (11, 0), (12, 0), (13, 0), (14, 0), (15, 0), (16, 0), (17, 0), (17, 30), (18, 0), (19, 0), (20, 0), (21, 0), (22, 0), (23, 0), (23, 30), (23, 45))
FLOW = "flowSegmentData struct<currentSpeed:double,freeFlowSpeed:double,confidence:double,roadClosure:boolean>"
SPEEDS = "routes array<struct<legs:array<struct<annotation:struct<speed:array<double>>>>>>"
ELEMENTS = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
ENTRY = "struct<id:string,file:string,sha256:string,bbox:array<double>,places:long,raw_bytes:long>"
MANIFEST = f"national {ENTRY}, tiles array<{ENTRY}>"
GENERIC = {"fuel": "Fuel station", "restaurant": "Restaurant", "cafe": "Café", "atm": "ATM", "parking": "Parking"}

#: What a provider answers: (HTTP status, value).
Fetch = Callable[..., tuple[int, object]]


def with_retries(fetch: Fetch, tries: int = 3, base: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> Callable[..., tuple[object, int, float]]:
    """Asks again after a 429, waiting ``base`` to the power of the try: (value or None, tries made, seconds waited)."""

    def ask(*request: object) -> tuple[object, int, float]:
        waited = 0.0
        for k in range(tries):
            status, value = fetch(*request)
            if status != 429:
                return (value if status == 200 else None), k + 1, waited
            if k < tries - 1:
                sleep(base**k)
                waited += base**k
        return None, tries, waited

    return ask


def fan_out(requests: DataFrame, fetch: Fetch, names: list[str], kind: str, parallel: int, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The requests with value (of the kind), tries and waited: each asked by one of ``parallel`` tasks, arguments from the named columns.

    What a provider doesn't answer is null.  A lost executor asks its own requests again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = with_retries(fetch, tries, sleep=sleep)
        for b in batches:
            got = [ask(*row) for row in b[names].itertuples(index=False, name=None)]
            yield b.assign(value=pd.Series([g[0] for g in got], index=b.index, dtype="object"), tries=[g[1] for g in got], waited=[g[2] for g in got])

    kinds = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    return requests.repartition(parallel).mapInPandas(run, f"{kinds}, value {kind}, tries int, waited double")


def once_for_equal(requests: DataFrame, key: list[str], ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Asks for one request of each key, as a cache would, and gives its value to all: columns of the requests and value."""
    distinct = requests.dropDuplicates(key)
    answers = ask(distinct).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)), "value")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(key)))
    return requests.join(answers, same).select(*requests.columns, "value")


def until_short(pages: DataFrame, number: str, size: str, full: int) -> DataFrame:
    """The pages up to the first that holds fewer rows than a full one, that one included."""
    short = pages.filter(F.col(size) < full).agg(F.min(number).alias("last"))
    return pages.join(F.broadcast(short)).filter(F.col("last").isNull() | (F.col(number) <= F.col("last"))).drop("last")  # one row


def flow_reading(body: Column) -> Column:
    """struct of a provider's flow answer: speeds, ratio (1 without a free speed), jam out of ten, reduction, confidence; null without a segment."""
    d = F.from_json(body, FLOW)["flowSegmentData"]
    cur, free, sure = (F.coalesce(d[n], F.lit(x)) for n, x in (("currentSpeed", 30.0), ("freeFlowSpeed", 30.0), ("confidence", 0.5)))
    ratio = F.when(free > 0, cur / free).otherwise(1.0)
    read = F.struct(cur.alias("current_speed"), free.alias("free_flow_speed"), F.bround(F.greatest(F.lit(0.0), (1 - ratio) * 10), 3).alias("jam_factor"), F.bround(ratio, 3).alias("congestion_ratio"), F.bround(F.greatest(F.lit(0.0), free - cur), 3).alias("speed_reduction"), F.bround(sure, 3).alias("confidence"))
    return F.when(body.isNotNull(), read)


def precise_flow(body: Column) -> Column:
    """The same for a road that is open and has a free speed; else null."""
    d = F.from_json(body, FLOW)["flowSegmentData"]
    return F.when(~F.coalesce(d["roadClosure"], F.lit(False)) & (d["freeFlowSpeed"] > 0), flow_reading(body))


def slots(times: tuple[tuple[int, int], ...]) -> Column:
    """Departures as minutes of the day."""
    return F.array(*(F.lit(h * 60 + m) for h, m in times))


def smart_slots(day: Column) -> Column:
    """The departures worth asking for on a day, by its class: Friday, Saturday, others."""
    d = F.dayofweek(day)
    return F.when(d == 6, slots(FRIDAY)).when(d == 7, slots(SATURDAY)).otherwise(slots(WEEKDAY))


def plan_requests(routes: DataFrame, day: str) -> DataFrame:
    """A row for each route (with lat1, lng1, lat2, lng2) and departure of PLAN_SLOTS, with the cache's key: rounded ends and the weekday."""
    key = F.concat_ws("|", *(F.format_string("%.3f", F.col(c)) for c in ("lat1", "lng1", "lat2", "lng2")), F.dayofweek(day).cast("string"))
    return routes.withColumn("cache_key", key).select("*", F.explode(slots(PLAN_SLOTS)).alias("slot"))


def leave_at(day: Column, slot: Column, now: Column) -> Column:
    """The moment of a departure; one that has passed is asked for a week later."""
    at = day.cast("timestamp_ntz") + F.make_dt_interval(mins=slot)
    return F.when(at <= now, at + F.expr("INTERVAL 7 DAYS")).otherwise(at)


def live_congestion(live: Column, night_cached: Column, night: Column, unaware: Column, stored: Column) -> Column:
    """struct<free, source, ratio, jam, delay>: a route's live seconds against the first baseline there is; null without a live one or any baseline."""
    free = F.coalesce(*(F.when(c > 0, c) for c in (night_cached, night, unaware, stored)))
    source = F.when(night_cached > 0, "night_predicted_cached").when(night > 0, "night_predicted").when(unaware > 0, "traffic_unaware").when(stored > 0, "stored_fallback")
    ratio = F.when((live > 0) & free.isNotNull(), F.greatest(F.lit(1.0), live / free))
    return F.when(ratio.isNotNull(), F.struct(free.alias("free"), source.alias("source"), F.round(ratio, 3).alias("ratio"), F.round(clamp((ratio - 1) / 0.5, 0.0, 1.0), 3).alias("jam"), F.greatest(F.lit(0.0), live - free).alias("delay")))


def duration_ratio(live: Column, free: Column) -> Column:
    """Live against free-flow seconds; null where either is missing or nought."""
    return F.when((live > 0) & (free > 0), F.bround(live / free, 3))


def segment_speed(traffic: Column, free: Column) -> Column:
    """struct<current_speed, free_flow_speed, jam_factor, congestion_ratio>: mean speeds of two annotated answers, in km/h; null without live ones."""
    def mean(body: Column) -> Column:
        s = F.get(F.get(F.from_json(body, SPEEDS)["routes"], F.lit(0))["legs"], F.lit(0))["annotation"]["speed"]
        return F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))

    cur = mean(traffic)
    base = F.when(mean(free) > 0, mean(free)).otherwise(cur)
    ratio = F.greatest(F.lit(0.0), 1 - cur / base)
    return F.when(cur.isNotNull(), F.struct(F.round(cur * 3.6, 1).alias("current_speed"), F.round(base * 3.6, 1).alias("free_flow_speed"), F.round(ratio * 10, 2).alias("jam_factor"), F.round(ratio, 3).alias("congestion_ratio")))


def map_places(answers: DataFrame, body: str, category: str) -> DataFrame:
    """A row for each node, way or relation of a map's answers that has a place: id, name, lat, lng, brand, phone, opening_hours, address."""
    rows = answers.select(F.col(category).alias("category"), F.explode(F.from_json(body, ELEMENTS)["elements"]).alias("e"))
    tag = lambda *names: X.first_of(*(F.try_element_at(F.col("e.tags"), F.lit(n)) for n in names))
    node = F.col("e.type") == "node"
    generic = F.create_map(*(F.lit(x) for p in GENERIC.items() for x in p))
    street = F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street"))
    rows = rows.select(
        F.concat_ws("/", F.lit("osm"), "e.type", F.col("e.id").cast("string")).alias("id"), "category", F.coalesce(tag("name:ar", "name", "brand"), F.try_element_at(generic, F.col("category")), F.lit("Place")).alias("name"), F.when(node, F.col("e.lat")).otherwise(F.col("e.center.lat")).alias("lat"), F.when(node, F.col("e.lon")).otherwise(F.col("e.center.lon")).alias("lng"),
        tag("brand").alias("brand"), tag("phone", "contact:phone").alias("phone"), tag("opening_hours").alias("opening_hours"), F.nullif(street, F.lit("")).alias("address"),
    )
    return rows.filter("lat is not null and lng is not null")


def tiles_of(manifest: Column) -> Column:
    """The valid tiles of a manifest, the national one first; null where that is bad."""
    m = F.from_json(manifest, MANIFEST)
    valid = lambda e: e["id"].rlike("^[A-Za-z0-9_-]{1,64}$") & e["file"].isNotNull() & e["sha256"].isNotNull() & (F.size(e["bbox"]) == 4)
    return F.when(F.coalesce(valid(m["national"]), F.lit(False)) & m["tiles"].isNotNull(), F.concat(F.array(m["national"]), F.filter(m["tiles"], lambda e: F.coalesce(valid(e), F.lit(False)))))


def verified(content: Column, sha256: Column) -> Column:
    """Whether a file is the one that the manifest names."""
    return F.sha2(content, 256) == F.lower(sha256)


def tile_reaches(bbox: Column, lat: Column, lng: Column, metres: Column) -> Column:
    """Whether a tile's box (west, south, east, north) comes within so many metres of a point, by degrees."""
    up, side = metres / 111_000, metres / (111_000 * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))
    return (bbox[2] >= lng - side) & (bbox[0] <= lng + side) & (bbox[3] >= lat - up) & (bbox[1] <= lat + up)
