"""Sources, sinks and remaining composite queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masar.functions import codecs as C
from masar.functions import geo as G
from masar.functions import levels as L
from masar.functions import text as X
from masar.functions import times as T
from masar.operators import plans as P
from masar.operators import readings as R
from masar.operators import routes as O
from masar.plans.geometry import CUM, CUS, SUP, _SEG, along, customers, hav, points, suppliers
from masar.plans.registry import query, table, table_in_order



@query("src_junction_csv", f"SELECT s_suppkey AS junction_idx, round(lat, 4) AS latitude, round(lng, 4) AS longitude, CASE WHEN s_nationkey % 2 = 0 THEN 'Cairo' ELSE 'Giza' END AS governorate FROM {SUP}")
def junction_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("junction_idx"), F.round("lat", 4).alias("latitude"), F.round("lng", 4).alias("longitude"), F.when(F.col("s_nationkey") % 2 == 0, "Cairo").otherwise("Giza").alias("governorate"))


@query("src_combined_csv", "SELECT s_suppkey, 'real' AS junction_type, '' AS road_name FROM supplier")
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    from masar.sources import connectors

    return connectors.combined(spark, None, table(spark, sf_dir, "supplier").select("s_suppkey"))



@query("src_mvt")
def vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that aren't a tile have no features; a layer around each supplier's name has one."""
    name = F.encode("s_name", "UTF-8")
    one = lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))
    feature = F.lit(bytes([0x12, 4, 0x22, 2, 9, 0]))
    layer = F.concat(F.lit(b"\x0a"), one(F.octet_length("s_name")), name, feature)
    tile = F.concat(F.lit(b"\x1a"), one(F.length(layer)), layer)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.size(C.decode_tile(tile)).alias("features"))


@query("fn_mvt_decode")
def tile_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.concat(F.lit(b"\x0a"), F.unhex(F.lpad(F.hex(F.octet_length("s_name")), 2, "0")), F.encode("s_name", "UTF-8"), F.lit(bytes([0x12, 4, 0x22, 2, 9, 0])))
    tile = F.concat(F.lit(b"\x1a"), F.unhex(F.lpad(F.hex(F.length(layer)), 2, "0")), layer)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.get(C.decode_tile(tile), F.lit(0))["layer"].alias("layer"))


@query("prj_select", "SELECT o_orderkey, o_orderstatus FROM orders")
def select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")



@query("gr_virtual")
def virtual_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points each 2 km along each route, thinned to 1.5 km from the last kept one, with ids."""
    kept = O.densified(along(spark, sf_dir), "route", 2.0).groupBy("route").agg(F.array_sort(F.collect_list("km")).alias("kms"))
    each = kept.select("route", F.posexplode(O.keep_by_gap(F.col("kms"), 1.5)).alias("n", "km"))
    return each.select(F.format_string("V_%d_%03d", "route", "n").alias("junction_id"), F.round("km", 3).alias("km"))


@query("sink_graph", f"SELECT a.s_suppkey AS src, b.s_suppkey AS dst, CAST(round({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 1) AS FLOAT)::DOUBLE AS weight FROM {SUP} a JOIN {SUP} b ON b.s_suppkey = a.s_suppkey + 1")
def graph_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("src"), F.col("lat").alias("a"), F.col("lng").alias("b"))
    b = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("dst"), F.col("lat").alias("c"), F.col("lng").alias("d"))
    km = F.round(G.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 1)
    return a.join(b, F.col("dst") == F.col("src") + 1).select("src", "dst", km.cast("float").cast("double").alias("weight"))


@query("join_point_segment", f"""
WITH t AS (SELECT *, CASE WHEN (b2 - lng)*(b2 - lng) + (a2 - lat)*(a2 - lat) = 0 THEN 0 ELSE greatest(0, least(1, ((31.25 - lng)*(b2 - lng) + (30.05 - lat)*(a2 - lat))/((b2 - lng)*(b2 - lng) + (a2 - lat)*(a2 - lat)))) END AS t FROM {_SEG} WHERE a2 IS NOT NULL)
SELECT route, round(min({hav('30.05', '31.25', '(lat + t*(a2-lat))', '(lng + t*(b2-lng))', '6371000.0::DOUBLE')}), 2) AS m FROM t GROUP BY route HAVING min({hav('30.05', '31.25', '(lat + t*(a2-lat))', '(lng + t*(b2-lng))', '6371000.0::DOUBLE')}) <= 2000""")
def point_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("route").orderBy("pos")
    s = points(spark, sf_dir).withColumns({"a2": F.lead("lat").over(by), "b2": F.lead("lng").over(by)}).filter("a2 is not null")
    m = G.segment_distance_plain(F.col("lat"), F.col("lng"), F.col("a2"), F.col("b2"), F.lit(30.05), F.lit(31.25))
    return s.groupBy("route").agg(F.min(m).alias("d")).filter("d <= 2000").select("route", F.round("d", 2).alias("m"))


@query("win_poly_eta", f"""
WITH t AS (SELECT *, max(cum) OVER (PARTITION BY route) AS total FROM {CUM})
SELECT route, junction, round(min(cum/nullif(total, 0)*1800), 3) AS eta FROM t WHERE total > 0 GROUP BY route, junction""")
def poly_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = along(spark, sf_dir).withColumn("total", F.max("cum").over(Window.partitionBy("route"))).filter("total > 0")
    return t.groupBy("route", "junction").agg(F.round(F.min(F.col("cum") / F.col("total") * 1800), 3).alias("eta"))


@query("win_group_island", """
WITH s AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS h, avg(value) > 30 AS hot FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h) - row_number() OVER (PARTITION BY user_id, hot ORDER BY h) AS g FROM s)
SELECT user_id, min(h) AS first, max(h) AS last, count(*) AS n FROM n WHERE hot GROUP BY user_id, g""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbroken runs of busy hours."""
    e = table_in_order(spark, sf_dir, "events").withColumn("h", F.hour("ts"))
    s = e.withColumn("v", R.mean_in_order(F.col("value"), "user_id", "h")).groupBy("user_id", "h").agg((F.first("v") > 30).alias("hot"))
    late = F.asc_nulls_last("h")
    g = F.row_number().over(Window.partitionBy("user_id").orderBy(late)) - F.row_number().over(Window.partitionBy("user_id", "hot").orderBy(late))
    return s.withColumn("g", g).filter("hot").groupBy("user_id", "g").agg(F.min("h").alias("first"), F.max("h").alias("last"), F.count("*").alias("n")).drop("g")


@query("ord_demo_best", "SELECT l_orderkey, list(l_suppkey ORDER BY n) AS junctions FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_partkey) AS n FROM lineitem) WHERE n <= 3 GROUP BY l_orderkey")
def demo_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_suppkey", "l_partkey"))
    top = table(spark, sf_dir, "lineitem").withColumn("n", n).filter("n <= 3").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "l_suppkey"))).alias("x"))
    return top.select("l_orderkey", F.transform("x", lambda v: v["l_suppkey"]).alias("junctions"))


@query("fn_remaining", f"WITH d AS (SELECT *, max(cum) OVER (PARTITION BY route) - cum AS rest FROM {CUM}) SELECT route, CAST(pos AS BIGINT) AS pos, round(rest, 5) AS rest FROM d")
def remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.max("cum").over(Window.partitionBy("route")) - F.col("cum")
    return along(spark, sf_dir).select("route", F.col("pos").cast("long").alias("pos"), F.round(rest, 5).alias("rest"))


@query("fn_buffer", "SELECT p_partkey, round(1 + 0.5*(p_size/50.0::DOUBLE), 3) AS buffer FROM part")
def buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", L.buffer(F.col("p_size") / 50.0).alias("buffer"))


@query("fn_jam_adaptive", "SELECT p_partkey, round(least(1, greatest(0, (p_size/20.0::DOUBLE - 1)/0.5)), 3) AS jam FROM part")
def jam_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", L.jam_adaptive(F.col("p_size"), F.lit(20)).alias("jam"))


_DAY = "datediff('day', DATE '2000-01-01', day)"


def _sun_sql(days: str) -> str:
    """(declination in degrees, equation of time in hours) as columns de and eq of a subquery over days."""
    return f"""(SELECT *, degrees(asin(sin(tilt)*sin(lam))) AS de, ((q/15 - ((degrees(atan2(cos(tilt)*sin(lam), cos(lam)))/15) % 24 + 24) % 24 + 12) % 24 + 24) % 24 - 12 AS eq FROM
 (SELECT *, radians((q + 1.915*sin(g) + 0.020*sin(2*g)) % 360) AS lam, radians(23.439 - 0.00000036*days) AS tilt FROM (SELECT *, radians((357.529 + 0.98560028*days) % 360) AS g, (280.459 + 0.98564736*days) % 360 AS q FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, {days} AS days FROM (SELECT o_orderdate, CAST(o_orderdate AS DATE) AS day FROM orders)))))"""


@query("fn_sun", f"SELECT day, round(de, 4) AS declination, round(eq, 5) AS equation FROM {_sun_sql(f'CAST({_DAY} AS DOUBLE)')}")
def sun(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    declination, eqt = P.sun(F.datediff("day", F.lit("2000-01-01").cast("date")).cast("double"))
    return d.select("day", F.round(declination, 4).alias("declination"), F.round(eqt, 5).alias("equation"))


@query("dt_time_from_slot", "SELECT CAST(s AS INTEGER) AS slot, printf('%02d:%02d', (300 + 15*s)//60, (300 + 15*s) % 60) AS clock FROM range(76) t(s)")
def time_from_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = spark.range(76).select(F.col("id").cast("int").alias("slot"))
    return slots.select("slot", T.clock_of_minutes(T.slot_minute(F.col("slot"))).alias("clock"))


@query("dt_dow", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow FROM orders")
def dow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.weekday("o_orderdate").alias("dow"))


@query("dt_fmt_cairo", "SELECT event_id, strftime(timezone('Africa/Cairo', timezone('UTC', ts)), '%H:%M') AS clock FROM events")
def cairo_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format(T.cairo(F.col("ts").cast("timestamp")), "HH:mm").alias("clock"))


@query("tx_is_arabic", f"SELECT doc_id, regexp_matches(text, '[{X.ARABIC}]') AS arabic FROM documents")
def is_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(f"[{X.ARABIC}]").alias("arabic"))



_KINDS = {"ring": "jewel", "plate": "dish", "box": "store"}



_COUNTS = f"(SELECT conv_id, turn, length(regexp_replace(text, '[^{X.ARABIC}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS la FROM conversations)"


@query("tx_in_script", f"SELECT conv_id, turn, la = 0 OR ar = 0 AS pure FROM {_COUNTS}")
def in_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    ar, la = X.script_counts(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ((la == 0) | (ar == 0)).alias("pure"))


@query("tx_stt_script", f"SELECT conv_id, turn, CASE WHEN ar + la = 0 THEN NULL WHEN ar/(ar + la)::DOUBLE >= 0.7 THEN 'ar' WHEN la/(ar + la)::DOUBLE >= 0.7 THEN 'en' END AS script FROM {_COUNTS}")
def stt_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    ar, la = X.script_counts(F.col("text"))
    share = ar / F.nullif(ar + la, F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(share >= 0.7, "ar").when(1 - share >= 0.7, "en").alias("script"))



@query("tx_geojson_flip", f"SELECT s_suppkey, round(lat, 4) AS lat, round(lng, 4) AS lng FROM {SUP}")
def geojson_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.from_json(F.concat(F.lit("["), F.round("lng", 4).cast("string"), F.lit(","), F.round("lat", 4).cast("string"), F.lit("]")), "array<double>")
    return suppliers(spark, sf_dir).withColumn("p", pair).filter(F.size("p") >= 2).select("s_suppkey", F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(0)).alias("lng"))



@query("cq_derive_junctions", f"SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey FROM (SELECT c_custkey, s_suppkey, {hav('(c.lat + 30.05)/2', '(c.lng + 31.25)/2', 's.lat', 's.lng')} AS d FROM {CUS} c, {SUP} s) WHERE d <= 2.5 GROUP BY c_custkey")
def derive_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of the straight line to a centre, matched to the nearest junction."""
    middle = customers(spark, sf_dir).withColumns({"lat": (F.col("lat") + 30.05) / 2, "lng": (F.col("lng") + 31.25) / 2})
    return O.nearest(middle, suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 2.5).select("c_custkey", "s_suppkey")



def _prayers_sql() -> str:
    noon, la, cosine = "(12 + 2 - 31.25/15 - eq)", "radians(30.05)", "cos(radians(30.05))*cos(radians(de))"
    hours = lambda alt: f"degrees(acos((sin(radians({alt})) - sin({la})*sin(radians(de)))/({cosine})))/15"
    asr = "degrees(atan(1/(1 + tan(radians(abs(30.05 - de))))))"
    cols = {"fajr": f"{noon} - {hours(-P.FAJR_ANGLE)}", "sunrise": f"{noon} - {hours(-P.SUNSET_ANGLE)}", "dhuhr": noon, "asr": f"{noon} + {hours(asr)}", "maghrib": f"{noon} + {hours(-P.SUNSET_ANGLE)}", "isha": f"{noon} + {hours(-P.ISHA_ANGLE)}"}
    return f"(SELECT day, {', '.join(f'round({v}, 4) AS {k}' for k, v in cols.items())} FROM {_sun_sql(f'{_DAY} - 31.25/360')})"


PRAYERS = _prayers_sql()


@query("fn_prayer", f"SELECT * FROM {PRAYERS}")
def prayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six times of each order's date in the middle of the city."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select("day", *P.prayer_columns(F.col("day"), F.lit(30.05), F.lit(31.25), F.lit(2.0)))



@query("cq_prayers", f"""
WITH t AS (SELECT p.*, n.fajr AS next_fajr, (p.day - DATE '1990-01-01') * 7 % 24 AS now FROM {PRAYERS} p LEFT JOIN {PRAYERS} n ON n.day = p.day + 1)
SELECT day, CASE WHEN now < fajr THEN 'fajr' WHEN now < dhuhr THEN CASE WHEN isodow(day) = 5 THEN 'jumuah' ELSE 'dhuhr' END WHEN now < asr THEN 'asr' WHEN now < maghrib THEN 'maghrib' WHEN now < isha THEN 'isha' ELSE 'fajr' END AS next, now >= isha AS tomorrow FROM t""")
def prayers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next prayer after some hour of each order's date, tomorrow's first after the last; on Fridays the noon prayer has a name of its own."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    t = d.select("day", *P.prayer_columns(F.col("day"), F.lit(30.05), F.lit(31.25), F.lit(2.0)))
    now = F.datediff("day", F.lit("1990-01-01").cast("date")) * 7 % 24
    return t.select("day", P.next_prayer(F.col("day"), now).alias("n")).select("day", "n.*")


@query("cq_along_pois", f"WITH k AS (SELECT route, min(cum) FILTER (WHERE {hav('lat', 'lng', '30.05', '31.25')} <= 5) AS a, count(*) AS n FROM {CUM} GROUP BY route) SELECT route, CASE WHEN a IS NULL THEN 'fallback' ELSE 'index' END AS source FROM k")
def along_pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes without a hit in the index go to the other source."""
    near = F.when(G.haversine(F.col("lat"), F.col("lng"), F.lit(30.05), F.lit(31.25)) <= 5, F.col("cum"))
    return along(spark, sf_dir).groupBy("route").agg(F.min(near).alias("a")).select("route", F.when(F.col("a").isNull(), "fallback").otherwise("index").alias("source"))


@query("cq_find_places", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part WHERE p_size <= 12) WHERE n <= 3")
def find_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detours of twelve minutes at most, then a lens, then the count."""
    n = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf_dir, "part").filter("p_size <= 12").withColumn("n", n).filter("n <= 3").select("p_type", "p_partkey")


@query("cq_resolve_pois", "SELECT p_type, coalesce(min(p_partkey) FILTER (WHERE p_size <= 5), min(p_partkey)) AS p_partkey FROM part GROUP BY p_type")
def resolve_pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.coalesce(F.min(F.when(F.col("p_size") <= 5, F.col("p_partkey"))), F.min("p_partkey")).alias("p_partkey"))



@query("st_jury_grace", "SELECT user_id, count(*) AS witnesses FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, min(ts) OVER (PARTITION BY user_id) AS t FROM events) WHERE n <= 2 OR (n = 3 AND ts <= t + INTERVAL 600 SECOND) GROUP BY user_id")
def jury_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers are waited for, a third only for a grace."""
    by = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(by.orderBy("ts", "event_id"))).withColumn("t", F.min("ts").over(by))
    return e.filter((F.col("n") <= 2) | ((F.col("n") == 3) & (F.col("ts") <= F.col("t") + F.expr("INTERVAL 600 SECONDS")))).groupBy("user_id").agg(F.count("*").alias("witnesses"))


@query("st_scan_trigger", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS tick, count(*) AS n FROM events GROUP BY 1")
def scan_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each ten-minute trigger would find."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("tick"), "n")


@query("st_collect_trigger", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS tick, count(DISTINCT user_id) AS junctions FROM events GROUP BY 1")
def collect_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count_distinct("user_id").alias("junctions")).select(F.col("w.start").alias("tick"), "junctions")
