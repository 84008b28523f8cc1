"""Assistant, place-search and scan queries that combine other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masar.functions import geo as G
from masar.functions import speech as Z
from masar.operators import readings as R
from masar.operators import routes as O
from masar.plans.geometry import CUM, CUS, SUP, along, customers, hav, suppliers
from masar.plans.registry import query, table
from masar.plans.traffic import READ, read


@query("tx_is_arabizi", f"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '([a-z0-9'']+)', 1) AS ws FROM conversations),
h AS (SELECT conv_id, turn, len(ws) AS n, len(list_filter(ws, lambda w: w NOT IN ('2nd', '3rd') AND regexp_matches(w, '{'|'.join(Z.DIGIT_SHAPES)}'))) AS d, len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in Z.STRONG)}))) AS s, len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in Z.COMMON)}))) AS c FROM w)
SELECT conv_id, turn, d >= 1 OR s >= 1 OR c >= 2 OR (c = 1 AND n <= 2) AS arabizi FROM h""")
def arabizi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Z.is_arabizi(F.col("text")).alias("arabizi"))


@query("tx_explicit_lang", f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '{Z.ASK_ENGLISH}') THEN 'en' WHEN regexp_matches(lower(text), '{Z.ASK_ARABIC}') THEN 'ar' END AS lang FROM conversations")
def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Z.asked_language(F.col("text")).alias("lang"))



@query("tx_number_words")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", Z.spoken_number(F.floor("o_totalprice").cast("long")).alias("said"))


@query("tx_clock_words")
def clock_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", Z.spoken_clock(F.hour("ts") * 60 + F.minute("ts")).alias("said"))



@query("prj_context", "SELECT o_orderkey, concat_ws(chr(10), 'Status: ' || o_orderstatus, CASE WHEN o_totalprice > 100000 THEN 'Price: ' || CAST(floor(o_totalprice) AS BIGINT) END, 'Priority: ' || o_orderpriority) AS block FROM orders")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of lines from what is known; missing pieces leave no line."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", F.concat(F.lit("Status: "), "o_orderstatus"), F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("Price: "), F.floor("o_totalprice").cast("string"))), F.concat(F.lit("Priority: "), "o_orderpriority")).alias("block"))


@query("prj_tools_for", "SELECT p_partkey, list_sort(list_distinct(list_concat(list_intersect(string_split(p_name, ' '), ['small', 'ring', 'blue']), ['info']))) AS tools FROM part")
def tools_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array_intersect(F.split("p_name", " "), F.array(*(F.lit(w) for w in ("small", "ring", "blue"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_union(allowed, F.array(F.lit("info")))).alias("tools"))


@query("prj_place_row", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END, n_name, 'place') AS name, concat_ws(', ', nullif(n_name, ''), CASE WHEN s_acctbal > 0 THEN 'open' END) AS address FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def place_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return s.select("s_suppkey", F.coalesce(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")), "n_name", F.lit("place")).alias("name"), F.concat_ws(", ", F.nullif("n_name", F.lit("")), F.when(F.col("s_acctbal") > 0, "open")).alias("address"))


@query("prj_osm_row", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN 'ar' END, CASE WHEN event_type = 'click' THEN 'name' END, 'generic') AS name FROM events")
def osm_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the tags that may name an element, from a map."""
    tags = F.map_filter(F.create_map(F.lit("name:ar"), F.when(F.col("event_type") == "view", "ar"), F.lit("name"), F.when(F.col("event_type") == "click", "name")), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(tags, F.lit("name:ar")), F.try_element_at(tags, F.lit("name")), F.lit("generic")).alias("name"))


@query("prj_null_safe", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END, 0) AS jam, coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END, 'FREE') AS level FROM orders")
def null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("jam"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("level"))
    return o.na.fill({"jam": 0.0, "level": "FREE"})


@query("flt_eq_gte_lte", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 50000 AND o_totalprice <= 150000")
def builder_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") >= 50000) & (F.col("o_totalprice") <= 150000)).select("o_orderkey")


@query("src_rest_select", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rest_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection, predicate, order and limit, all of which reach the scan or its top-k."""
    return table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25)


@query("src_doc_store", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 21:00:00') WHERE n <= 12")
def doc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three hours' newest twelve of each key."""
    e = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-30 21:00:00").cast("timestamp_ntz"))
    return R.latest(e, "user_id", 12).select("user_id", "event_id")



_NEARBY = f"(SELECT c_custkey, s_suppkey, {hav('c.lat', 'c.lng', 's.lat', 's.lng', '6371008.8::DOUBLE')}/1000 AS km, {hav('c.lat', 'c.lng', 's.lat', 's.lng')} AS d FROM {CUS} c, {SUP} s)"


@query("ord_nearest", f"SELECT c_custkey, s_suppkey, CAST(n AS BIGINT) AS n FROM (SELECT c_custkey, s_suppkey, d, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS n FROM {_NEARBY} WHERE d <= 8) WHERE n <= 20")
def ord_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = O.nearest_sites(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 20, 8.0)
    return near.select("c_custkey", "s_suppkey", F.col("n").cast("long").alias("n"))


@query("cq_eta_to", f"SELECT c_custkey, round(min(d)/30*60, 4) AS minutes FROM {_NEARBY} WHERE d <= 8 GROUP BY c_custkey")
def eta_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = O.nearest_sites(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 1, 8.0)
    return near.select("c_custkey", F.round(F.col("km") / 30 * 60, 4).alias("minutes"))


@query("ord_corridor", f"""
WITH k AS (SELECT route, max(cum) AS total, min(cum) FILTER (WHERE {hav('lat', 'lng', '30.05', '31.25')} <= 5) AS along FROM {CUM} GROUP BY route)
SELECT route, round(along, 5) AS along FROM k WHERE along IS NOT NULL ORDER BY along, route LIMIT 200""")
def corridor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = G.haversine(F.col("lat"), F.col("lng"), F.lit(30.05), F.lit(31.25)) <= 5
    k = along(spark, sf_dir).filter(near).groupBy("route").agg(F.min("cum").alias("along"))
    return k.orderBy("along", "route").limit(200).select("route", F.round("along", 5).alias("along"))


@query("cq_anchors", f"SELECT route, CAST(CASE WHEN total <= 0 THEN 1 WHEN total <= 18 THEN least(12, floor(total/1.5) + 1) ELSE 12 + least(8, floor((total - 18)/1.5) + 1) END AS INTEGER) AS n FROM (SELECT route, max(cum) AS total FROM {CUM} GROUP BY route)")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many search centres a route gets: a near band each 1.5 km, and eight at most over the rest."""
    t = along(spark, sf_dir).groupBy("route").agg(F.max("cum").alias("total"))
    per = lambda x, most: F.least(F.lit(most), F.floor(x / 1.5) + 1)
    return t.select("route", F.when(F.col("total") <= 0, 1).when(F.col("total") <= 18, per(F.col("total"), 12)).otherwise(12 + per(F.col("total") - 18, 8)).cast("int").alias("n"))


@query("win_sample_along", f"SELECT route, CAST(CASE WHEN total <= 0 THEN 1 ELSE least(10, floor(total/5) + 1) END AS INTEGER) AS n, round(CASE WHEN floor(total/5) + 1 > 10 THEN total/9 ELSE 5 END, 5) AS spacing FROM (SELECT route, max(cum) AS total FROM {CUM} GROUP BY route)")
def sample_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points each 5 km, ten at most; a longer route widens the spacing."""
    t = along(spark, sf_dir).groupBy("route").agg(F.max("cum").alias("total"))
    n = F.floor(F.col("total") / 5) + 1
    return t.select("route", F.when(F.col("total") <= 0, 1).otherwise(F.least(F.lit(10), n)).cast("int").alias("n"), F.round(F.when(n > 10, F.col("total") / 9).otherwise(5.0), 5).alias("spacing"))


@query("ps_route_dist", f"SELECT route, round(min({hav('lat', 'lng', '30.05', '31.25', '6371008.8::DOUBLE')}), 2) AS m FROM {CUM} GROUP BY route")
def route_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return along(spark, sf_dir).groupBy("route").agg(F.round(F.min(G.haversine(F.col("lat"), F.col("lng"), F.lit(30.05), F.lit(31.25), G.RADIUS_PLACE_M)), 2).alias("m"))



@query("cq_details", "SELECT 'rm:' || p_partkey AS pid, p_name FROM part")
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places looked up by ids with a prefix."""
    asked_ = table(spark, sf_dir, "part").select(F.concat(F.lit("rm:"), F.col("p_partkey").cast("string")).alias("pid"))
    own = asked_.withColumn("k", F.regexp_replace("pid", "^rm:", "").cast("long"))
    return own.join(table(spark, sf_dir, "part"), F.col("k") == F.col("p_partkey")).select("pid", "p_name")



@query("cq_enrich", f"SELECT route, count(*) FILTER (WHERE lat BETWEEN 29.9 AND 30.1) AS inside, round(count(*) FILTER (WHERE lat BETWEEN 29.9 AND 30.1)/count(*)::DOUBLE, 6) AS coverage FROM {CUM} GROUP BY route")
def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.count_if(F.col("lat").between(29.9, 30.1))
    return along(spark, sf_dir).groupBy("route").agg(inside.alias("inside"), F.round(inside / F.count("*"), 6).alias("coverage"))


@query("cq_demo_corridor", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS worst FROM orders GROUP BY o_custkey")
def demo_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("worst"))


@query("cq_collect", """
WITH u AS (SELECT DISTINCT l_suppkey % 150 AS j FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1998-06-01'), e AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY user_id)
SELECT CASE WHEN n >= 8 THEN 'skipped' WHEN n IS NULL THEN 'no_data' ELSE 'collected' END AS outcome, count(*) AS junctions FROM u LEFT JOIN e ON e.user_id = u.j GROUP BY 1""")
def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct junctions of the trips ahead, and what is to be done for each."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))
    u = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_suppkey") % 150).alias("j")).distinct()
    e = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).groupBy("user_id").agg(F.count("*").alias("n"))
    return u.join(e, F.col("user_id") == F.col("j"), "left").groupBy(F.when(F.col("n") >= 8, "skipped").when(F.col("n").isNull(), "no_data").otherwise("collected").alias("outcome")).agg(F.count("*").alias("junctions"))


@query("cq_traffic_check", f"""
WITH n AS (SELECT s_suppkey, min(d) AS d FROM {_NEARBY} WHERE d <= 1.5 GROUP BY s_suppkey), a AS (SELECT junction, avg(cur/100) AS live, avg(jam10/10) AS usual FROM {READ} GROUP BY junction)
SELECT s_suppkey, CASE WHEN live > usual + 0.12 THEN 'worse' WHEN live < usual - 0.12 THEN 'better' ELSE 'normal' END AS verdict FROM n JOIN a ON a.junction = s_suppkey % 150""")
def traffic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = O.nearest(suppliers(spark, sf_dir), customers(spark, sf_dir), "s_suppkey", "c_custkey", 1.5)
    a = read(spark, sf_dir).groupBy("junction").agg(F.avg(F.col("cur") / 100).alias("live"), F.avg(F.col("jam10") / 10).alias("usual"))
    return near.join(a, F.col("junction") == F.col("s_suppkey") % 150).select("s_suppkey", R.verdict(F.col("live"), F.col("usual")).alias("verdict"))


@query("cq_tool_rules", "SELECT event_id, CASE WHEN value > 240 THEN 'too_long' WHEN event_type = 'error' THEN 'emergency' WHEN value < 5 THEN 'now' ELSE 'set' END AS answer FROM events")
def tool_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("value") > 240, "too_long").when(F.col("event_type") == "error", "emergency").when(F.col("value") < 5, "now").otherwise("set")
    return table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))



@query("cq_follow_up", "SELECT event_id, CASE WHEN value < 1 THEN 'silence' WHEN value/500 < 0.55 THEN 'unsure' ELSE 'answer' END AS turn FROM events")
def follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 1, "silence").when(F.col("value") / 500 < 0.55, "unsure").otherwise("answer").alias("turn"))



@query("st_plan_progressive", "SELECT user_id, CAST(hour(ts) AS INTEGER) AS slot, 'provisional' AS kind, round(avg(value), 6) AS v FROM events GROUP BY ALL UNION ALL SELECT user_id, CAST(hour(ts) AS INTEGER), 'update', round(avg(value)*1.1, 6) FROM events WHERE event_type = 'view' GROUP BY ALL")
def progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional slots first, refined ones after."""
    e = table(spark, sf_dir, "events")
    slot = lambda rows, kind, by: rows.groupBy("user_id", F.hour("ts").alias("slot")).agg(F.round(F.avg("value") * by, 6).alias("v")).select("user_id", "slot", F.lit(kind).alias("kind"), "v")
    return slot(e, "provisional", 1.0).union(slot(e.filter("event_type = 'view'"), "update", 1.1))
