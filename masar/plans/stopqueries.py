"""Queries of stops: kinds and names of places, requests to add, remove and switch, messages, the monitor of trips."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masar.functions import levels as L
from masar.functions import stops as S
from masar.operators import monitor
from masar.plans.registry import query, table

#: What is asked for, over the parts: chains, kinds, and the parts' own names.
ASKED = ("Master on the ring", "the nearest gas station", "best coffee", "كنتاكي", "somewhere fun", "أقرب صيدلية", "")
_ASKED_SQL = f"(SELECT *, CASE WHEN p_partkey % 7 = 6 THEN p_name ELSE [{', '.join(repr(a) for a in ASKED)}][CAST(p_partkey % 7 AS INTEGER) + 1] END AS asked FROM part)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("p_partkey") % 7).cast("int")
    return table(spark, sf_dir, "part").withColumn("asked", F.when(k == 6, F.col("p_name")).otherwise(F.get(F.array(*map(F.lit, ASKED)), k)))


def _norm(c: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({c}, '')), 'أإآةىـ', 'اااهي'), '\\s+', ' ', 'g'))"


def _list(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _mentions(n: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({n}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _brand(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {_mentions(n, names)} THEN '{kind}'" for kind, names in S.BRANDS) + " END"


@query("tx_brand", f"SELECT p_partkey, {_brand(_norm('asked'))} AS kind FROM {_ASKED_SQL}")
def brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("p_partkey", S.brand_kind(F.col("asked")).alias("kind"))


def _bare(n: str, leads: Iterable[str]) -> str:
    return f"regexp_replace({n}, '^(?:(?:{'|'.join(leads)}) )+', '')"


@query("tx_category", f"SELECT p_partkey, CASE {' '.join(f'''WHEN {_bare(_norm('asked'), S.LEADS)} IN ({_list(w)}) THEN '{k}' ''' for k, w in S.GENERIC.items())} END AS kind FROM {_ASKED_SQL}")
def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("p_partkey", S.generic_kind(F.col("asked")).alias("kind"))


def _type_of(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} IN ({_list(w)}) THEN '{k}'" for k, w in S.TYPES.items()) + " END"


_SINGLE = " ".join(f"WHEN len(list_intersect(ws, [{_list(x for x in w if ' ' not in x)}])) > 0 THEN '{k}'" for k, w in S.TYPES.items() if any(" " not in x for x in w))


@query("tx_place_type", f"""
SELECT p_partkey, CASE WHEN {_mentions('n', S.OPEN_ENDED)} THEN NULL WHEN b IS NOT NULL THEN CASE b {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TYPE_OF_KIND.items())} END ELSE coalesce({_type_of('n')}, {_type_of('bare')}, CASE {_SINGLE} END) END AS type
FROM (SELECT *, {_brand('n')} AS b, {_bare('n', (*S.LEADS, *S.MORE_LEADS))} AS bare, string_split({_bare('n', (*S.LEADS, *S.MORE_LEADS))}, ' ') AS ws FROM (SELECT p_partkey, {_norm('asked')} AS n FROM {_ASKED_SQL}))""")
def place_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("p_partkey", S.place_type(F.col("asked")).alias("type"))


_CHAIN = "CASE " + " ".join(f"WHEN {_mentions('q', names)} THEN {_mentions('n', names)}" for _, names in S.BRANDS) + " ELSE false END"


@query("tx_name_match", f"""
SELECT p_partkey, CASE WHEN q = '' OR contains(n, q) OR {_CHAIN} OR len(list_intersect(string_split(q, ' '), string_split(n, ' '))) >= 0.5*len(list_distinct(string_split(q, ' '))) THEN 'strong' ELSE 'weak' END AS match
FROM (SELECT p_partkey, {_norm('asked')} AS q, {_norm("CASE WHEN p_size % 2 = 0 THEN 'Master Ring KFC' ELSE p_name END")} AS n FROM {_ASKED_SQL})""")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("p_size") % 2 == 0, "Master Ring KFC").otherwise(F.col("p_name"))
    return asked(spark, sf_dir).select("p_partkey", S.name_match(F.col("asked"), found).alias("match"))


@query("cq_stop_policy", """
WITH d AS (SELECT p_partkey, p_name, p_size AS km, CASE WHEN p_partkey % 5 > 0 THEN p_size*3 END AS mins, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN 'ask' WHEN k = 3 THEN 'none' WHEN mins > 120 THEN 'too_far' WHEN k = 1 AND mins <= 8 THEN 'auto' WHEN k = 2 AND mins <= 8 THEN 'auto' ELSE 'confirm' END AS decision FROM d""")
def stop_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of no place, of the place that is found, of a kind of place, and of one that isn't found."""
    k, none = F.col("p_partkey") % 4, F.lit(None).cast("string")
    minutes = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 3)
    name = F.when(k == 0, "stop").when((k == 1) | (k == 3), F.col("p_name")).when(k == 2, "the nearest gas station")
    found = F.when(k == 3, none).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.stop_decision(name, none, found, minutes, F.col("p_size").cast("double")).alias("decision"))


_STOPS = "(SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey, p_name) AS stops FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)"


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda v: v["p_name"]).alias("stops"))


@query("cq_remove_stop", f"""
WITH h AS (SELECT l_orderkey, stops, list_filter(stops, lambda s: contains(s, 'widget')) AS hits FROM {_STOPS})
SELECT l_orderkey, CASE WHEN len(hits) = 1 THEN hits[1] WHEN len(hits) = 0 AND len(stops) = 1 THEN stops[1] END AS name FROM h""")
def remove_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one stop of each order that "Widget" means; with none or several the caller asks."""
    return _stops(spark, sf_dir).withColumn("r", S.removed_stop(F.col("stops"), F.lit("Widget"), F.lit(False))).select("l_orderkey", "r.name")


_ALTS = "(SELECT l_orderkey, list({'i': l_linenumber, 'via': p_name, 'd': CAST(round((l_tax - l_discount)*100) AS INTEGER)} ORDER BY l_linenumber, l_partkey, p_name) AS alts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)"


def _alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    alt = F.struct(F.col("l_linenumber").alias("index"), F.col("p_name").alias("via"), F.round((F.col("l_tax") - F.col("l_discount")) * 100).cast("int").alias("delta"))
    return li.join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.collect_list(alt).alias("alts"))


@query("join_alt_match", f"SELECT l_orderkey, CASE WHEN len(h) = 1 THEN h[1].i END AS alternative FROM (SELECT l_orderkey, list_filter(alts, lambda a: contains(a.via, 'blue') OR contains(a.via, 'bolt')) AS h FROM {_ALTS})")
def alt_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one alternative that "the Blue Bolt road" means."""
    return _alternatives(spark, sf_dir).select("l_orderkey", S.matching_alternative(F.lit("the Blue Bolt road"), F.col("alts")).alias("alternative"))


@query("cq_switch", f"SELECT l_orderkey, CASE WHEN best.d < 0 THEN best.i END AS alternative FROM (SELECT l_orderkey, list_sort(list_transform(alts, lambda a: {{'d': a.d, 'i': a.i}}))[1] AS best FROM {_ALTS})")
def switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternative that saves most, unless none does."""
    return _alternatives(spark, sf_dir).select("l_orderkey", S.fastest_alternative(F.col("alts")).alias("alternative"))


@query("cq_detours", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 45 THEN CAST(greatest(0, round_even((l_extendedprice/10 - l_quantity*60)/60, 0)) AS INTEGER) END AS minutes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n <= 8")
def detours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the first eight candidates would add to its trip, where both durations are known."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = table(spark, sf_dir, "lineitem").withColumn("n", n).filter("n <= 8")
    base = F.when(F.col("l_quantity") < 45, F.col("l_quantity") * 60)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.added_minutes(F.col("l_extendedprice") / 10, base).alias("minutes"))


@query("tx_notification", """
WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'improvement' WHEN 'click' THEN 'escalation' ELSE 'new' END AS kind, CAST(floor(value/10) AS INTEGER) AS d, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS INTEGER) END AS b, (value - 10*floor(value/10)) AS j FROM events),
l AS (SELECT *, CASE WHEN j >= 8 THEN 'CRITICAL' WHEN j >= 5.5 THEN 'SERIOUS' WHEN j >= 3.2 THEN 'WARNING' WHEN j >= 1.5 THEN 'ADVISORY' ELSE 'FREE' END AS level FROM e)
SELECT event_id, CASE WHEN kind = 'improvement' AND (d < 5 OR level IN ('FREE', 'ADVISORY')) THEN 'That earlier traffic has melted away. You''re good to leave right on schedule — enjoy the drive.'
 WHEN kind = 'improvement' THEN 'It''s down to about ' || d || ' extra minutes now' || CASE WHEN b > 0 THEN ' (was +' || b || ')' ELSE '' END || '. Your planned time should work again.'
 WHEN kind = 'escalation' THEN 'The slowdown grew since we last checked — now about ' || d || ' extra minutes' || CASE WHEN b > 0 THEN ', up from +' || b ELSE '' END || '. If you can head out 10 min early, now''s the moment.'
 WHEN level = 'CRITICAL' THEN 'It''s rough out there — about ' || d || ' extra minutes on your route' || CASE WHEN j >= 3 THEN ' — the slow stretch hits about ' || CAST(floor(j) AS INTEGER) || ' min into your drive' ELSE '' END || '. Leave 10 min early and you''ll still make it comfortably.'
 WHEN level = 'SERIOUS' THEN 'Your route is running about ' || d || ' minutes slower than usual' || CASE WHEN j >= 3 THEN ' — the slow stretch hits about ' || CAST(floor(j) AS INTEGER) || ' min into your drive' ELSE '' END || '. A 10-minute head start keeps you on time.'
 ELSE 'A bit of traffic' || CASE WHEN j >= 3 THEN ' — the slow stretch hits about ' || CAST(floor(j) AS INTEGER) || ' min into your drive' ELSE '' END || ' — roughly ' || d || ' extra minutes. Nothing major, but leave a few minutes early if you''re cutting it close.' END AS body FROM l""")
def notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    jam: Column = F.col("value") - 10 * F.floor(F.col("value") / 10)
    kind = F.when(F.col("event_type") == "view", "improvement").when(F.col("event_type") == "click", "escalation").otherwise("new")
    said = S.notification(kind, L.level_jam10(jam), F.floor(F.col("value") / 10).cast("int"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("int")), jam, F.lit(10), F.lit("Home"))
    return table(spark, sf_dir, "events").select("event_id", said["body"].alias("body"))


_TICKS = "(SELECT unnest(generate_series(TIMESTAMP '1997-06-01', TIMESTAMP '1997-06-03', INTERVAL 15 MINUTE)) AS tick)"
_TRIPS = "(SELECT o_orderkey AS trip, o_orderstatus, TIMESTAMP '1997-06-01' + INTERVAL (o_orderkey % 2900) MINUTE AS departure FROM orders)"


@query("st_cf_monitor", f"""
WITH d AS (SELECT tick, trip, departure, date_diff('second', tick, departure) AS ahead FROM {_TRIPS} JOIN {_TICKS} ON departure >= tick AND departure <= tick + INTERVAL 60 MINUTE WHERE o_orderstatus = 'O'),
s AS (SELECT *, (trip + CAST(epoch(tick) AS BIGINT)//900) % 3 = 0 AS should, (trip % 40)/4.0 AS delay FROM d),
c AS (SELECT trip, min(tick) AS tick FROM s WHERE ahead BETWEEN 300 AND 600 AND NOT should GROUP BY trip)
SELECT tick, trip, CASE WHEN should AND delay >= 5 THEN 'alert' ELSE 'scan' END AS sent FROM s UNION ALL SELECT tick, trip, 'all_clear' FROM c""")
def trip_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of ticks over orders as trips, each scanned at every tick of its last hour."""
    start = F.lit("1997-06-01 00:00:00").cast("timestamp")
    trips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("done").alias("status"), (start + F.make_dt_interval(mins=(F.col("o_orderkey") % 2900).cast("int"))).alias("departure"))
    ticks = spark.range(193).select((start + F.make_dt_interval(mins=(F.col("id") * 15).cast("int"))).alias("tick"))
    fifteen = F.explode(F.sequence(F.lit(0), F.lit(4)))
    at = F.timestamp_seconds(F.floor(F.unix_seconds("departure") / 900) * 900 - F.col("k") * 900)
    scans = trips.select("trip", "departure", fifteen.alias("k")).select("trip", at.alias("at")).withColumns({"should_alert": (F.col("trip") + F.floor(F.unix_seconds("at") / 900)) % 3 == 0, "delay": F.col("trip") % 40 / 4.0})
    out = monitor.monitored(trips, scans, ticks)
    return out.select(F.col("tick").cast("timestamp_ntz").alias("tick"), "trip", "sent")
