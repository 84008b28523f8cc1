"""Queries of feeds and sinks: providers' answers built from the tables and read back as rows, requests fanned out, tables written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masar.plans.geometry import CUS, SUP, customers, suppliers
from masar.plans.registry import query, table
from masar.plans.traffic import READ, read
from masar.sources import feeds, sinks

_FLOW = f"(SELECT *, event_type = 'error' AS closed FROM {READ})"


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as a provider's answers: errors are closed roads, and every seventh junction doesn't answer."""
    body = F.to_json(F.struct(F.struct(F.col("cur").alias("currentSpeed"), F.col("free").alias("freeFlowSpeed"), F.lit(0.9).alias("confidence"), (F.col("event_type") == "error").alias("roadClosure")).alias("flowSegmentData")))
    return read(spark, sf_dir).withColumn("body", F.when(F.col("junction") % 7 > 0, body))


@query("src_flow_point", f"SELECT event_id, CASE WHEN junction % 7 > 0 THEN cur END AS current_speed, CASE WHEN junction % 7 > 0 THEN round_even(greatest(0, (1 - CASE WHEN free > 0 THEN cur/free ELSE 1 END)*10), 3) END AS jam_factor FROM {_FLOW}")
def flow_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir).withColumn("r", feeds.flow_reading(F.col("body"))).select("event_id", "r.current_speed", "r.jam_factor")


@query("src_flow_precise", f"SELECT event_id, cur AS current_speed FROM {_FLOW} WHERE NOT closed AND free > 0 AND junction % 7 > 0")
def flow_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir).withColumn("r", feeds.precise_flow(F.col("body"))).filter("r is not null").select("event_id", "r.current_speed")


def _speed(junction: int) -> tuple[int, object]:
    """A provider in memory: some junctions are refused at first, some never answer."""
    return (500, None) if junction % 11 == 0 else (200, 20.0 + junction % 50)


@query("src_flow_many", "SELECT s_suppkey AS junction, 20.0::DOUBLE + s_suppkey % 50 AS speed FROM supplier WHERE s_suppkey % 11 <> 0")
def flow_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all junctions by several tasks; those without an answer are dropped."""
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("junction"))
    return feeds.fan_out(asked, _speed, ["junction"], "double", 8).filter("value is not null").select("junction", F.col("value").alias("speed"))


class _Refusing:
    """A provider that refuses an order's request as often as its number says, by the requests it has had."""

    def __init__(self) -> None:
        self.seen: dict[int, int] = {}

    def __call__(self, order: int) -> tuple[int, object]:
        self.seen[order] = self.seen.get(order, 0) + 1
        return (429, None) if self.seen[order] <= order % 5 else (200, 60 * (order % 40))


@query("src_route_dur", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(60*(o_orderkey % 40) AS INTEGER) END AS seconds, CAST(least(o_orderkey % 5 + 1, 3) AS INTEGER) AS tries, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2.5 END::DOUBLE AS waited FROM orders")
def route_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations from a provider that refuses some requests: three tries, with longer and longer waits."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey")
    return feeds.fan_out(asked, _Refusing(), ["o_orderkey"], "int", 8, sleep=lambda s: None).select("o_orderkey", F.col("value").alias("seconds"), "tries", "waited")


_SLOTS = "[" + ", ".join(str(h * 60 + m) for h, m in feeds.PLAN_SLOTS) + "]"


@query("src_plan27", f"SELECT c_custkey, CAST(slot AS INTEGER) AS slot, CAST(600 + slot + CAST(round(lat*1000) AS INTEGER) % 100 AS INTEGER) AS seconds FROM (SELECT c_custkey, lat, unnest({_SLOTS}) AS slot FROM {CUS})")
def plan27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """27 departures for each customer's route; routes of equal rounded ends are asked for once."""
    routes = customers(spark, sf_dir).select("c_custkey", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), F.lit(30.05).alias("lat2"), F.lit(31.25).alias("lng2"))
    asked = feeds.plan_requests(routes, F.lit("2026-07-16").cast("date"))

    def ask(rows: DataFrame) -> DataFrame:
        return feeds.fan_out(rows, lambda lat, slot: (200, 600 + slot + int(round(lat * 1000)) % 100), ["lat1", "slot"], "int", 8)

    return feeds.once_for_equal(asked, ["cache_key", "slot"], ask).select("c_custkey", "slot", F.col("value").alias("seconds"))


@query("src_plan_stream", f"SELECT c_custkey, CAST(slot AS INTEGER) AS slot, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY (slot - c_custkey % 1440 + 1440) % 1440, slot) AS INTEGER) AS n FROM (SELECT c_custkey, unnest({_SLOTS}) AS slot FROM customer)")
def plan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which departures are worth asking for: the next one first, around the clock."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(feeds.slots(feeds.PLAN_SLOTS)).alias("slot"))
    ahead = F.pmod(F.col("slot") - F.col("c_custkey") % 1440, F.lit(1440))
    return rows.select("c_custkey", "slot", F.row_number().over(Window.partitionBy("c_custkey").orderBy(ahead, "slot")).alias("n"))


def _times(times: tuple[tuple[int, int], ...]) -> str:
    return "[" + ", ".join(str(h * 60 + m) for h, m in times) + "]"


@query("src_google_plan", f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT o_orderkey, day, unnest(CASE dayofweek(day) WHEN 5 THEN {_times(feeds.FRIDAY)} WHEN 6 THEN {_times(feeds.SATURDAY)} ELSE {_times(feeds.WEEKDAY)} END) AS slot FROM d)
SELECT o_orderkey, CAST(slot AS INTEGER) AS slot, CASE WHEN day + INTERVAL (slot) MINUTE <= CAST(day AS TIMESTAMP) + INTERVAL 9 HOUR THEN CAST(day AS TIMESTAMP) + INTERVAL (slot) MINUTE + INTERVAL 7 DAY ELSE CAST(day AS TIMESTAMP) + INTERVAL (slot) MINUTE END AS leave FROM s""")
def google_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty departures by the class of the day, asked at nine: those that have passed are a week later."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.explode(feeds.smart_slots(day)).alias("slot"))
    return rows.select("o_orderkey", "slot", feeds.leave_at(F.col("day"), F.col("slot"), F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS")).alias("leave"))


@query("src_google_cong", """
WITH b AS (SELECT o_orderkey, o_totalprice AS live, CASE WHEN o_orderkey % 3 = 0 THEN 90000.0 END AS cached, CASE WHEN o_orderkey % 3 = 1 THEN 95000.0 END AS night, CASE WHEN o_orderkey % 2 = 0 THEN 80000.0 END AS unaware, CASE WHEN o_orderkey % 5 > 0 THEN 100000.0 END AS stored FROM orders),
f AS (SELECT *, coalesce(cached, night, unaware, stored)::DOUBLE AS free FROM b)
SELECT o_orderkey, CASE WHEN free IS NOT NULL THEN round(greatest(1, live/free), 3) END AS ratio, CASE WHEN cached IS NOT NULL THEN 'night_predicted_cached' WHEN night IS NOT NULL THEN 'night_predicted' WHEN unaware IS NOT NULL THEN 'traffic_unaware' WHEN stored IS NOT NULL THEN 'stored_fallback' END AS source FROM f""")
def congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = feeds.live_congestion(F.col("o_totalprice"), F.when(k % 3 == 0, 90000.0), F.when(k % 3 == 1, 95000.0), F.when(k % 2 == 0, 80000.0), F.when(k % 5 > 0, 100000.0))
    return table(spark, sf_dir, "orders").withColumn("c", c).select("o_orderkey", "c.ratio", "c.source")


@query("src_mapbox_dur", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN round_even(o_totalprice/(1000 + o_orderkey % 9), 3) END AS ratio FROM orders")
def mapbox_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live against free-flow seconds of two answers, the second of which fails now and then."""
    free = F.when(F.col("o_orderkey") % 6 > 0, 1000 + F.col("o_orderkey") % 9)
    return table(spark, sf_dir, "orders").select("o_orderkey", feeds.duration_ratio(F.col("o_totalprice"), free).alias("ratio"))


@query("src_mapbox_seg", "SELECT vec_id, round(cur*3.6, 1) AS current_speed, round(greatest(0, 1 - cur/free)*10, 2) AS jam_factor FROM (SELECT vec_id, list_avg(list_transform(embedding, lambda x: 10 + 5*CAST(x AS DOUBLE))) AS cur, list_avg(list_transform(embedding, lambda x: 12 + 5*CAST(x AS DOUBLE))) AS free FROM embeddings)")
def mapbox_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated speeds of a live and a free-flow answer, averaged, in km/h."""
    body = lambda base: F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.transform("embedding", lambda x: base + 5 * x.cast("double")).alias("speed")).alias("annotation"))).alias("legs"))).alias("routes")))
    return table(spark, sf_dir, "embeddings").withColumn("s", feeds.segment_speed(body(10), body(12))).select("vec_id", "s.current_speed", "s.jam_factor")


@query("src_overpass", f"SELECT 'osm/' || CASE WHEN s_suppkey % 2 = 0 THEN 'node' ELSE 'way' END || '/' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Fuel station' WHEN 1 THEN 'S' || s_suppkey ELSE 'B' || s_suppkey END AS name, lat FROM {SUP} WHERE s_suppkey % 10 <> 9")
def overpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a map's answers: nodes by their point, ways by their centre, those without one dropped."""
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    tags = F.when(k % 3 == 1, F.create_map(F.lit("name"), F.concat(F.lit("S"), key), F.lit("brand"), F.lit("x"))).when(k % 3 == 2, F.create_map(F.lit("brand"), F.concat(F.lit("B"), key)))
    here = k % 10 != 9
    element = F.struct(F.when(k % 2 == 0, "node").otherwise("way").alias("type"), k.alias("id"), F.when((k % 2 == 0) & here, F.col("lat")).alias("lat"), F.when((k % 2 == 0) & here, F.col("lng")).alias("lon"), F.when((k % 2 == 1) & here, F.struct("lat", F.col("lng").alias("lon"))).alias("c"), F.when((k % 2 == 1) & here, F.struct("lat", "lng")).alias("center"), tags.alias("tags"))
    body = F.replace(F.to_json(F.struct(F.array(element).alias("elements"))), F.lit('"lng"'), F.lit('"lon"'))
    answers = suppliers(spark, sf_dir).select(F.lit("fuel").alias("category"), body.alias("body"))
    return feeds.map_places(answers, "body", "category").select("id", "name", "lat")


@query("src_place_tiles", f"""
WITH t AS (SELECT s_nationkey AS k, 'tile_' || s_nationkey AS id, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n, count(*) AS places FROM {SUP} GROUP BY s_nationkey)
SELECT id, places, k % 4 <> 3 AS verified, e >= 31.25 - 10000/(111000*cos(radians(30.05))) AND w <= 31.25 + 10000/(111000*cos(radians(30.05))) AND n >= 30.05 - 10000/111000.0 AND s <= 30.05 + 10000/111000.0 AS near FROM t WHERE k % 5 <> 4""")
def place_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid tiles of a manifest, whether their files are the named ones, and whether they come within 10 km of the city's middle."""
    t = suppliers(spark, sf_dir).groupBy("s_nationkey").agg(F.array(F.min("lng"), F.min("lat"), F.max("lng"), F.max("lat")).alias("bbox"), F.count("*").alias("places"))
    content = F.concat(F.lit("tile "), F.col("s_nationkey").cast("string"))
    entry = F.struct(F.when(F.col("s_nationkey") % 5 == 4, "../bad").otherwise(F.concat(F.lit("tile_"), F.col("s_nationkey").cast("string"))).alias("id"), F.lit("f").alias("file"), F.sha2(F.when(F.col("s_nationkey") % 4 == 3, "damaged").otherwise(content), 256).alias("sha256"), "bbox", "places")
    national = F.struct(F.lit("national").alias("id"), F.lit("f").alias("file"), F.lit("0").alias("sha256"), F.array(*map(F.lit, (31.0, 29.0, 32.0, 31.0))).alias("bbox"), F.lit(0).cast("long").alias("places"))
    manifest = t.agg(F.to_json(F.struct(national.alias("national"), F.sort_array(F.collect_list(entry)).alias("tiles"))).alias("m"))  # an entry for each nation
    tiles = manifest.select(F.explode(feeds.tiles_of(F.col("m"))).alias("e")).select("e.*").filter("id <> 'national'")
    file = F.encode(F.concat(F.lit("tile "), F.regexp_replace("id", "tile_", "")), "UTF-8")
    return tiles.select("id", "places", feeds.verified(file, F.col("sha256")).alias("verified"), feeds.tile_reaches(F.col("bbox"), F.lit(30.05), F.lit(31.25), F.lit(10_000.0)).alias("near"))


@query("src_rest_paged", "WITH o AS (SELECT o_orderkey, o_orderstatus, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page FROM orders), p AS (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM o WHERE o_orderkey % 2500 <> 777) SELECT o_orderkey FROM p WHERE page <= coalesce((SELECT min(page) FROM p WHERE n < 100), 1e9) AND o_orderstatus = 'O'")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table given out in pages of a hundred, read up to the first short one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    number = F.floor((F.row_number().over(Window.orderBy("o_orderkey")) - 1) / 100).cast("long")  # as the service numbers its rows
    rows = o.withColumn("page", number).filter("o_orderkey % 2500 <> 777")
    pages = feeds.until_short(rows.groupBy("page").agg(F.count("*").alias("n")), "page", "n", 100)
    return rows.join(pages.select("page"), "page").filter("o_orderstatus = 'O'").select("o_orderkey")


@query("src_json_cfg", "SELECT 'p' || n_nationkey AS name, CAST(n_regionkey AS BIGINT) AS value FROM nation UNION ALL SELECT 'columns', 25")
def json_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of JSON, written and read as options with a given schema, and the number of its columns."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("k"), F.col("n_regionkey").cast("long").alias("v"))
    one = n.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("options"), F.sort_array(F.collect_list("k")).alias("columns"))  # a row for each nation
    path = sinks.scratch(spark, "config")
    one.write.json(path)
    c = spark.read.schema("options map<string,bigint>, columns array<string>").json(path)
    return c.select(F.explode("options").alias("name", "value")).union(c.select(F.lit("columns"), F.size("columns").cast("long")))


# Sinks: each writes, and returns what is read back.


@query("sink_insert", "SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events UNION ALL SELECT user_id FROM events WHERE event_type = 'view') GROUP BY user_id")
def insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after two appends."""
    e, path = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), sinks.scratch(spark, "insert")
    sinks.append(e, path, "event_type")
    sinks.append(e.filter("event_type = 'view'"), path, "event_type")
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query("sink_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'revoked' ELSE o_orderstatus END AS status FROM orders")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after a filtered change of one column, merged and written as a new version."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("version"))
    changes = o.filter("o_orderkey % 10 = 0").withColumns({"status": F.lit("revoked"), "version": F.lit(1)})
    return sinks.merged(sinks.scratch(spark, "update"), o, changes, "o_orderkey", "version").select("o_orderkey", "status")


@query("sink_reading", f"SELECT event_id, hour, dow, dow IN (5, 6) AS is_weekend, dow = 4 AS is_friday FROM {READ}")
def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings appended with calendar columns as the collector stores them: its weekend is Saturday and Sunday."""
    path = sinks.scratch(spark, "reading")
    rows = read(spark, sf_dir).select("event_id", "hour", "dow", F.col("dow").isin(5, 6).alias("is_weekend"), (F.col("dow") == 4).alias("is_friday"))
    sinks.append(rows, path, "dow")
    return spark.read.parquet(path).select("event_id", "hour", "dow", "is_weekend", "is_friday")


@query("sink_virtual", "SELECT 'V_' || n_name || '_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS junction_id, 'virtual' AS junction_type FROM nation")
def virtual(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.scratch(spark, "virtual")
    sinks.append(table(spark, sf_dir, "nation").select(F.format_string("V_%s_%03d", "n_name", "n_nationkey").alias("junction_id"), F.lit("virtual").alias("junction_type")), path, "junction_type")
    return spark.read.parquet(path).select("junction_id", "junction_type")


@query("sink_checkpoint", "SELECT CAST(event_id // 5000 AS INTEGER) AS chunk, count(*) AS n, max(event_id) AS resume FROM events GROUP BY 1")
def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import by chunks that breaks off after the even ones and goes on: every row is there once."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 5000).cast("int").alias("chunk"))
    path = sinks.scratch(spark, "checkpoint")
    sinks.resumed(rows.filter("chunk % 2 = 0"), path, "chunk")
    return sinks.resumed(rows, path, "chunk").groupBy("chunk").agg(F.count("*").alias("n"), F.max("event_id").alias("resume"))


@query("sink_notify", "SELECT c_custkey, count(*) FILTER (WHERE (o_orderkey + t) % 4 > 0) AS sent, count(*) AS asked FROM customer JOIN orders ON o_custkey = c_custkey, (VALUES (0), (1)) v(t) WHERE o_orderstatus = 'F' GROUP BY c_custkey")
def notify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts to two tokens of each customer, of which some fail; what came of each is kept."""
    alerts = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("text"))
    tokens = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("token"))
    kept = sinks.notified(alerts, tokens, "c_custkey", sinks.scratch(spark, "notify"), lambda token, text: (int(text) + int(token)) % 4 > 0)
    return kept.groupBy("c_custkey").agg(F.count_if("sent").alias("sent"), F.count("*").alias("asked"))


@query("sink_cache_state", "SELECT n_nationkey AS tile, n_name || '.sqlite' AS file, CAST(n_regionkey AS BIGINT) AS used FROM nation")
def cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache's state, replaced as a whole twice, and read."""
    path = sinks.scratch(spark, "state")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("tile"), F.concat("n_name", F.lit(".sqlite")).alias("file"), F.col("n_regionkey").cast("long").alias("used"))
    sinks.replaced(rows.withColumn("used", F.lit(0).cast("long")), path)
    return sinks.replaced(rows, path)

