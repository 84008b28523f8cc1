"""Quotas, rate limits, alerts, plans and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masar.functions import levels as L
from masar.functions import times as T
from masar.operators import admission as A
from masar.operators import plans as P
from masar.operators import readings as R
from masar.plans.registry import query, table, table_in_order
from masar.streaming import stateful


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    day = F.to_date(T.cairo(ts)).cast("string")
    delay = F.floor(F.col("value") / 8).cast("int")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(ts).alias("us"), (F.unix_micros(ts) / 1e6).alias("s"), day.alias("day"), F.floor("value").cast("int").alias("amount"), L.level_jam10(F.col("value") - 10 * F.floor(F.col("value") / 10)).alias("level"), delay.alias("delay"), "event_type", (F.col("value") / 4).alias("minutes"))


_DAY = "CAST(timezone('Africa/Cairo', timezone('UTC', ts)) AS DATE)"


@query("st_daily_quota", f"SELECT event_id, row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of one: a rank within the key and day."""
    n = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("us", "event_id"))
    return _events(spark, sf_dir).select("event_id", (n <= 2).alias("admitted"))


@query("agg_daily_quota", f"""
WITH l AS (SELECT user_id, {_DAY} AS d, list({{'id': event_id, 'a': greatest(1, CAST(floor(value) AS BIGINT))}} ORDER BY ts, event_id) AS xs FROM events GROUP BY ALL),
f AS (SELECT list_reduce(xs, lambda acc, x: {{'u': CASE WHEN acc.u < 120 THEN acc.u + x.a ELSE acc.u END, 'ok': list_append(acc.ok, {{'id': x.id, 'ok': acc.u < 120}})}}, {{'u': 0::BIGINT, 'ok': CAST([] AS STRUCT(id BIGINT, ok BOOLEAN)[])}}) AS r FROM l)
SELECT x.id AS event_id, x.ok AS admitted FROM (SELECT unnest(r.ok) AS x FROM f)""")
def quota_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts overshoot once and then nothing is admitted until the next Cairo day."""
    return A.fold(_events(spark, sf_dir), "user_id", ["us", "event_id"], ["day", "amount"], A.quota(120), "event_id", "admitted", "boolean").select("event_id", "admitted")


@query("st_token_bucket")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fold(_events(spark, sf_dir), "user_id", ["us", "event_id"], ["s"], A.token_bucket(0.01, 3), "event_id", "admitted", "boolean").select("event_id", "admitted")


@query("st_fixed_window")
def fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fold(_events(spark, sf_dir), "user_id", ["us", "event_id"], ["s", "amount"], A.fixed_window(400, 43_200), "event_id", "admitted", "boolean").select("event_id", "admitted")


@query("st_alert_fsm")
def alert_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fold(_events(spark, sf_dir), "user_id", ["us", "event_id"], ["level", "delay"], A.alerts(), "event_id", "kind", "string").select("event_id", "kind")


@query("win_alert_prev")
def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_fsm(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("st_pre_departure_once", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE value/4 BETWEEN 0 AND 20 GROUP BY user_id")
def pre_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fold(_events(spark, sf_dir), "user_id", ["us", "event_id"], ["minutes"], A.once(), "event_id", "send", "boolean").filter("send").select("user_id", "event_id")


@query("st_lru")
def lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's cache of 300 units holds what an event asks for."""
    return A.fold(_events(spark, sf_dir), "user_id", ["us", "event_id"], ["event_type", "amount"], A.lru(300), "event_id", "hit", "boolean").select("event_id", "hit")


@query("agg_hit_stats")
def hit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.fold(_events(spark, sf_dir), "user_id", ["us", "event_id"], ["event_type", "amount"], A.lru(300), "event_id", "hit", "boolean")
    return hits.groupBy("user_id").agg(F.count("*").alias("lines"), F.count_if("hit").alias("hits"))


@query("st_ttl_cache", "SELECT user_id AS key, max(ts) AS ts FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 12 HOUR")
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts")
    return stateful.fresh(cache, "2024-01-30 23:00:00", 12 * 3600)


@query("st_fetch_budget", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 60")
def fetch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return _events(spark, sf_dir).withColumn("n", n).filter("n <= 60").select("user_id", "event_id")


@query("st_synth_cap", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) AS n FROM (SELECT *, {_DAY} AS d, row_number() OVER (PARTITION BY {_DAY}, user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1) WHERE n <= 50")
def synth_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flight for equal requests of a day, and a daily cap on flights."""
    first = _events(spark, sf_dir).groupBy("day", "user_id", "event_type").agg(F.min(F.struct("us", "event_id")).alias("f"))
    n = F.row_number().over(Window.partitionBy("day").orderBy("f"))
    return first.withColumn("n", n).filter("n <= 50").select(F.col("f.event_id").alias("event_id"))



@query("st_live_horizon", "SELECT event_id, CASE WHEN value/4 <= 60 THEN 'live' ELSE 'pattern' END AS source FROM events")
def live_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.when(F.col("minutes") <= 60, "live").otherwise("pattern").alias("source"))


@query("st_grace", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 5 MINUTE")
def grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-14 23:55:00").cast("timestamp_ntz")).select("event_id")


@query("dt_cairo_local", "SELECT event_id, CAST(hour(timezone('Africa/Cairo', timezone('UTC', ts))) AS INTEGER) AS hour FROM events")
def cairo_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.hour(T.cairo(F.col("ts").cast("timestamp"))).alias("hour"))


@query("dt_cairo_day", f"SELECT event_id, strftime({_DAY}, '%Y-%m-%d') AS day FROM events")
def cairo_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "day")


@query("dt_fixed_utc3", "SELECT event_id, CAST(hour(ts + INTERVAL 3 HOUR) AS INTEGER) AS hour FROM events")
def fixed_utc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.hour(F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("hour"))


@query("dt_quarter", "SELECT event_id, CAST(hour(ts)*4 + minute(ts)//15 AS INTEGER) AS quarter, CAST(isodow(ts) - 1 AS INTEGER) AS dow FROM events")
def quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.quarter(F.col("ts")).alias("quarter"), F.weekday("ts").alias("dow"))


@query("dt_slot_idx", "SELECT event_id, CAST((hour(ts)*60 + minute(ts) - 300)//15 AS INTEGER) AS slot FROM events WHERE hour(ts) >= 5")
def slot_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.hour("ts") >= 5).select("event_id", F.floor((F.hour("ts") * 60 + F.minute("ts") - 300) / 15).cast("int").alias("slot"))


@query("dt_next_night", "WITH l AS (SELECT event_id, timezone('Africa/Cairo', timezone('UTC', ts)) AS l FROM events), n AS (SELECT event_id, date_trunc('day', l) + INTERVAL 210 MINUTE AS n, l FROM l) SELECT event_id, strftime(timezone('UTC', timezone('Africa/Cairo', CASE WHEN n > l THEN n ELSE n + INTERVAL 1 DAY END)), '%Y-%m-%d %H:%M') AS night FROM n")
def next_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format(T.next_night(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("night"))


@query("dt_same_dow_future", "WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1998-06-03' AS t FROM orders) SELECT o_orderkey, strftime(CASE WHEN d >= t THEN d ELSE t + CAST(CASE WHEN (isodow(d) - isodow(t) + 7) % 7 = 0 THEN 7 ELSE (isodow(d) - isodow(t) + 7) % 7 END AS INTEGER) END, '%Y-%m-%d') AS day FROM d")
def same_dow_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.same_weekday_ahead(F.to_date("o_orderdate"), F.lit("1998-06-03").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("day"))


@query("dt_clock", "SELECT event_id, printf('%02d:%02d', m//60, m % 60) AS clock FROM (SELECT event_id, CAST(floor(value*9) AS INTEGER) % 1440 AS m FROM events)")
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.clock_of_minutes(F.floor(F.col("value") * 9).cast("int")).alias("clock"))


@query("dt_clock12", "SELECT event_id, printf('%d:%02d %s', (m//60 + 11) % 12 + 1, m % 60, CASE WHEN m < 720 THEN 'AM' ELSE 'PM' END) AS clock FROM (SELECT event_id, CAST(floor(value*9) AS INTEGER) % 1440 AS m FROM events)")
def clock12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.clock12(F.floor(F.col("value") * 9).cast("int")).alias("clock"))


@query("dt_expiry", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS expires FROM orders")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd").alias("expires"))


@query("dt_parse_utc", "SELECT event_id, epoch_us(ts)//1000000 AS s FROM events")
def parse_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps written as text and read again."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(T.parse_utc(text)).alias("s"))


@query("dt_slot_starts", "WITH f AS (SELECT event_id, date_trunc('minute', ts) + to_minutes(CAST((15 - minute(ts) % 15) % 15 AS INTEGER)) AS f FROM events) SELECT event_id, count(*) AS n, strftime(max(s), '%H:%M') AS last FROM (SELECT event_id, unnest(generate_series(f, f + INTERVAL 4 HOUR, INTERVAL 15 MINUTE)) AS s FROM f) GROUP BY event_id")
def slot_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    first = ts + F.make_dt_interval(mins=F.pmod(-F.minute("ts"), F.lit(15)))
    slots = F.sequence(first, first + F.expr("INTERVAL 4 HOURS"), F.expr("INTERVAL 15 MINUTES"))
    return table(spark, sf_dir, "events").select("event_id", F.size(slots).cast("long").alias("n"), F.date_format(F.element_at(slots, -1), "HH:mm").alias("last"))


_CURVE = """(SELECT user_id, list(coalesce(v, 0) ORDER BY k) AS curve FROM (SELECT u.user_id, k.k, avg((e.value - 10*floor(e.value/10))/10) AS v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(168) k(k) LEFT JOIN events e ON e.user_id = u.user_id AND (isodow(e.ts) - 1)*24 + hour(e.ts) = k.k GROUP BY ALL) GROUP BY user_id)"""
_ROUTE = f"(SELECT l_orderkey AS route, list(curve ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS cs FROM lineitem JOIN {_CURVE} c ON c.user_id = l_suppkey % 150 GROUP BY l_orderkey)"


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.routes_with_curves(table(spark, sf_dir, "lineitem"), P.curves(table(spark, sf_dir, "events")))


@query("win_tier1_fold", f"""
SELECT route, round(r.e, 4) AS elapsed, round(r.j/len(cs), 6) AS jam01 FROM (SELECT route, cs, list_reduce(cs, lambda a, c: {{'e': a.e + 1800.0::DOUBLE/len(cs)*(1 + 1.5::DOUBLE*c[CAST(48 + floor((8*3600 + a.e + 900.0::DOUBLE/len(cs))/3600) % 24 AS BIGINT) + 1]), 'j': a.j + c[CAST(48 + floor((8*3600 + a.e + 900.0::DOUBLE/len(cs))/3600) % 24 AS BIGINT) + 1]}}, {{'e': 0::DOUBLE, 'j': 0::DOUBLE}}) AS r FROM {_ROUTE})""")
def tier1_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's usual jam is looked up at the hour that the delays so far lead to."""
    f = P.tier1(F.col("curves"), F.lit(8), F.lit(2), F.lit(1800.0))
    return _routes(spark, sf_dir).select("route", f.alias("f")).select("route", F.round("f.elapsed", 4).alias("elapsed"), F.round("f.jam", 6).alias("jam01"))


@query("win_timeline", f"""
SELECT route, round(list_reduce(cs, lambda a, c: {{'e': a.e + 1800.0::DOUBLE/len(cs)*(1 + 1.5::DOUBLE*c[CAST(48 + floor((8*3600 + 1800 + a.e + 900.0::DOUBLE/len(cs))/3600) % 24 AS BIGINT) + 1])}}, {{'e': 0::DOUBLE}}).e, 4) AS elapsed FROM {_ROUTE}""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the departure's minutes kept: from half past eight."""
    f = P.tier1(F.col("curves"), F.lit(8.5), F.lit(2), F.lit(1800.0))
    return _routes(spark, sf_dir).select("route", f.alias("f")).select("route", F.round("f.elapsed", 4).alias("elapsed"))


_BEST = f"""(SELECT route, h, list_reduce(cs, lambda a, c: {{'e': a.e + 1800.0::DOUBLE/len(cs)*(1 + 1.5::DOUBLE*c[CAST(48 + floor((h*3600 + a.e + 900.0::DOUBLE/len(cs))/3600) % 24 AS BIGINT) + 1]), 'j': a.j + c[CAST(48 + floor((h*3600 + a.e + 900.0::DOUBLE/len(cs))/3600) % 24 AS BIGINT) + 1]}}, {{'e': 0::DOUBLE, 'j': 0::DOUBLE}}).j/len(cs) AS j FROM {_ROUTE}, range(5, 24) t(h))"""



@query("win_rank_routes", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS rank FROM orders")
def rank_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).alias("rank"))


@query("agg_best_route", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def best_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("agg_best_slot", "SELECT user_id, CAST(arg_min(hour(ts), (value, ts, event_id)) AS INTEGER) AS hour FROM events GROUP BY user_id")
def best_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by(F.hour("ts"), F.struct("value", "ts", "event_id")).alias("hour"))


@query("agg_minmax_slots", "SELECT user_id, min(value) AS free_flow, max(value) AS worst FROM events GROUP BY user_id")
def minmax_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("free_flow"), F.max("value").alias("worst"))


_SERIES = "(SELECT user_id, CAST(hour(ts) AS INTEGER) AS h, avg(value) AS v FROM events GROUP BY ALL)"


@query("agg_best_window", f"""
WITH s AS {_SERIES}, m AS (SELECT *, min(v) OVER (PARTITION BY user_id) AS lo FROM s), n AS (SELECT *, v <= lo + 20 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY h) AS n FROM m),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, ok ORDER BY h) AS g FROM n), b AS (SELECT user_id, arg_min(g, (v, h)) AS bg, max(v) - min(v) AS spread FROM g WHERE ok OR true GROUP BY user_id)
SELECT g.user_id, min(h) AS from_hour, max(h) AS to_hour, round(any_value(b.spread), 6) AS spread FROM g JOIN b ON g.user_id = b.user_id AND g.g = b.bg AND g.ok GROUP BY g.user_id""")
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of slots around the best that stay within a margin of it."""
    e = table_in_order(spark, sf_dir, "events").withColumn("h", F.hour("ts"))
    s = e.withColumn("v", R.mean_in_order(F.col("value"), "user_id", "h")).groupBy("user_id", "h").agg(F.first("v").alias("v"))
    return P.best_window(s, "user_id", "h", "v", 20.0).select("user_id", F.col("first").alias("from_hour"), F.col("last").alias("to_hour"), F.round("spread", 6).alias("spread"))


@query("win_interp", """
WITH a AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS h, avg(value) AS v FROM events WHERE hour(ts) % 3 = 0 GROUP BY ALL), s AS (SELECT user_id, CAST(h AS INTEGER) AS h FROM (SELECT DISTINCT user_id FROM a), range(24) t(h)),
j AS (SELECT s.user_id, s.h, a.v, CASE WHEN a.v IS NOT NULL THEN s.h END AS k FROM s LEFT JOIN a USING (user_id, h)),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(k IGNORE NULLS) OVER b AS k0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(k IGNORE NULLS) OVER f AS k1 FROM j WINDOW b AS (PARTITION BY user_id ORDER BY h ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, h, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR k0 = k1 THEN v0 ELSE v0 + (h - k0)/(k1 - k0)::DOUBLE*(v1 - v0) END, 6) AS v, CASE WHEN v IS NOT NULL THEN 'anchor' ELSE 'interpolated' END AS kind FROM w""")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").filter(F.hour("ts") % 3 == 0).groupBy("user_id", F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    return P.interpolated(a, "user_id", "h", "v", 0, 23).select("user_id", "h", F.round("filled", 6).alias("v"), F.when(F.col("v").isNotNull(), "anchor").otherwise("interpolated").alias("kind"))


@query("fn_slot_build", """
WITH b AS (SELECT event_id, CAST(floor(value*CASE WHEN isodow(ts) = 4 THEN 11 ELSE 10 END) AS INTEGER) AS d, hour(ts) AS h, isodow(ts) - 1 AS w FROM events),
j AS (SELECT *, round(least(1, greatest(0, (d/1500.0::DOUBLE - 1)/0.5)), 3) AS base FROM b)
SELECT event_id, round(least(1, base + CASE WHEN w = 4 THEN 0.08::DOUBLE WHEN w = 3 AND (h BETWEEN 7 AND 10 OR h BETWEEN 16 AND 20) THEN 0.10::DOUBLE ELSE 0 END), 3) AS jam, CAST(floor(d*(1 + base/2) + 1e-6) AS INTEGER) AS seconds FROM j""")
def slot_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thursday's durations grow by a tenth; the bars get the weekday's boost, the duration doesn't."""
    e = table(spark, sf_dir, "events")
    d = F.floor(F.col("value") * F.when(F.weekday("ts") == 3, 11).otherwise(10)).cast("int")
    s = e.select("event_id", d.alias("d"), F.hour("ts").alias("h"), F.weekday("ts").alias("w"))
    s = s.withColumn("base", F.round(L.clamp((F.col("d") / 1500.0 - 1) / 0.5, 0.0, 1.0), 3))
    return s.select("event_id", F.round(F.least(F.lit(1.0), F.col("base") + L.dow_boost(F.col("w"), F.col("h"))), 3).alias("jam"), F.floor(F.col("d") * (1 + F.col("base") / 2) + 1e-6).cast("int").alias("seconds"))


@query("ord_slots_from_now", "SELECT event_id, CAST((CAST(hour(ts)*60 + minute(ts) AS INTEGER) - 500 + 1440) % 1440 AS INTEGER) AS ahead FROM events")
def slots_from_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.pmod(F.hour("ts") * 60 + F.minute("ts") - 500, F.lit(1440)).alias("ahead"))



@query("prj_row_state", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'revoked' WHEN o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1998-06-01' THEN 'expired' ELSE 'live' END AS state FROM orders")
def row_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", P.row_state(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), F.lit("1998-06-01").cast("timestamp_ntz")).alias("state"))


@query("prj_live_view", "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderdate < TIMESTAMP '1998-06-01' AS ended FROM orders")
def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderstatus") == "F") | (F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz"))).alias("ended"))


@query("sink_gc", "SELECT o_orderkey FROM orders WHERE NOT (CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 1 DAY ELSE o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 30 DAY END)")
def gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows are kept a day past their end, links thirty."""
    limit = F.lit("1998-06-01").cast("timestamp_ntz")
    gone = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") < limit - F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate") < limit - F.expr("INTERVAL 30 DAYS"))
    return table(spark, sf_dir, "orders").filter(~gone).select("o_orderkey")


@query("cq_user_key", "SELECT c_custkey, CASE WHEN length(c_name) BETWEEN 8 AND 18 AND c_custkey % 2 = 0 THEN 'dev:' || c_name ELSE 'ip:' || trim(string_split('10.0.0.1, 10.0.0.' || c_nationkey, ',')[-1]) END AS key FROM customer")
def user_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    hops = F.concat(F.lit("10.0.0.1, 10.0.0."), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.user_key(device, hops).alias("key"))


@query("flt_valid_point", "SELECT doc_id FROM (SELECT doc_id, TRY_CAST(string_split(text, ' ')[1] AS DOUBLE) AS lat FROM documents) WHERE lat BETWEEN -90 AND 90 AND NOT isnan(lat)")
def valid_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.split("text", " ")[0].try_cast("double")
    return table(spark, sf_dir, "documents").filter(lat.isNotNull() & ~F.isnan(lat) & lat.between(-90, 90)).select("doc_id")



@query("tx_duration_parse", "SELECT event_id, CASE WHEN event_type = 'view' THEN -1 ELSE CAST(floor(value) AS INTEGER) END AS seconds FROM events")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") != "view", F.concat(F.floor("value").cast("string"), F.lit("s")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.regexp_extract(text, "^([0-9]+)s$", 1).try_cast("int"), F.lit(-1)).alias("seconds"))



@query("join_anti_stale", "SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def anti_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    return table(spark, sf_dir, "supplier").join(current, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_nationkey").distinct()


@query("join_semi_can", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_can(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    return table(spark, sf_dir, "supplier").join(allowed, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("join_brand", "SELECT a.p_partkey, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type GROUP BY a.p_partkey")
def brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places share brand and type: a count for each pair of keys joined back, not a pair for each two places."""
    p = table(spark, sf_dir, "part")
    return p.join(p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), ["p_brand", "p_type"]).select("p_partkey", "n")


@query("join_trip_scan", "SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey")
def trip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("set_candidates", "SELECT DISTINCT p_partkey FROM (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' UNION ALL SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.filter(F.col("p_name").contains("ring")).union(p.filter("p_type = 'ECONOMY'")).union(p.filter("p_brand = 'Brand#2'")).select("p_partkey").distinct()


@query("set_exact_first", "SELECT p_partkey, n FROM (SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE WHEN p_name = 'small ring' THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS INTEGER) AS n FROM part) WHERE n <= 20")
def exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names before the rest: a top-k, then its places."""
    first = F.when(F.col("p_name") == "small ring", 0).otherwise(1)
    top = table(spark, sf_dir, "part").select("p_partkey", first.alias("f"), "p_retailprice").orderBy("f", F.desc("p_retailprice"), "p_partkey").limit(20)
    return top.select("p_partkey", F.row_number().over(Window.orderBy("f", F.desc("p_retailprice"), "p_partkey")).alias("n"))


@query("set_union_tiles", "SELECT n_nationkey FROM nation WHERE n_regionkey = 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def union_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    return n.filter("n_regionkey = 0").select("n_nationkey").union(s.filter("s_acctbal > 9000").select("s_nationkey")).union(c.filter("c_acctbal > 9900").select("c_nationkey")).distinct()


@query("set_parity", "(SELECT s_nationkey AS key, 'left' AS side FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey, 'left' FROM customer WHERE c_acctbal > 9000) UNION ALL (SELECT c_nationkey, 'right' FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey, 'right' FROM supplier WHERE s_acctbal > 5000)")
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("key"))
    b = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"))
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))


@query("ord_order_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey")


@query("ord_rank_key", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 50")
def rank_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_size", "p_partkey").limit(50).select("p_partkey")


@query("ord_lru_evict", "SELECT p_brand, count(*) AS evicted FROM (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS held FROM part) WHERE held > 500 GROUP BY p_brand")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that a running sum from the most recently used puts over the cap."""
    held = F.sum("p_size").over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf_dir, "part").withColumn("held", held).filter("held > 500").groupBy("p_brand").agg(F.count("*").alias("evicted"))


@query("agg_group_best", "SELECT p_brand, arg_min(p_partkey, (p_size, p_partkey)) AS nearest, max(p_retailprice) AS score FROM part GROUP BY p_brand")
def group_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("nearest"), F.max("p_retailprice").alias("score"))



@query("fn_minmax_scaler", """
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), e AS (SELECT k, min(x) AS lo, max(x) AS hi FROM x GROUP BY k)
SELECT vec_id, list(round(CASE WHEN hi > lo THEN (x - lo)/(hi - lo) ELSE 0 END, 6) ORDER BY k) AS scaled FROM x JOIN e USING (k) GROUP BY vec_id""")
def scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension between its least and its greatest."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    ends = e.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).agg(F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("ends"))
    unit = lambda v, r: F.when(r["hi"] > r["lo"], (v - r["lo"]) / (r["hi"] - r["lo"])).otherwise(0.0)
    return e.join(F.broadcast(ends)).select("vec_id", F.zip_with("x", "ends", lambda v, r: F.round(unit(v, r), 6)).alias("scaled"))  # one row, of a number for each dimension


@query("sink_ndjson", "SELECT o_orderkey, '{\"type\":\"slot\",\"k\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS line FROM orders")
def ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.lit("slot").alias("type"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))).alias("line"))


@query("sink_scan_rows", "SELECT o_orderkey AS trip, 'route' AS kind, -1::BIGINT AS junction FROM orders UNION ALL SELECT l_orderkey, 'junction', l_suppkey FROM lineitem")
def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.lit("route").alias("kind"))
    spots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.lit("junction").alias("kind"), F.col("l_suppkey").alias("junction"))
    return route.unionByName(spots, allowMissingColumns=True).withColumn("junction", F.coalesce("junction", F.lit(-1)))


@query("cq_scan_trip", """
WITH s AS (SELECT l_orderkey AS trip, avg(l_discount*100) AS jam, max(l_discount*100) AS worst, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT *, CAST(floor(worst*2) AS INTEGER) AS delay,
 CASE WHEN worst >= 8 THEN 'CRITICAL' WHEN worst >= 5.5 THEN 'SERIOUS' WHEN worst >= 3.2 THEN 'WARNING' WHEN worst >= 1.5 THEN 'ADVISORY' ELSE 'FREE' END AS l0 FROM s),
e AS (SELECT *, CASE WHEN l0 = 'CRITICAL' AND delay < 18 THEN 'SERIOUS' ELSE l0 END AS l1 FROM d), f AS (SELECT *, CASE WHEN l1 = 'SERIOUS' AND delay < 10 THEN 'WARNING' ELSE l1 END AS l2 FROM e)
SELECT trip, round(jam, 4) AS jam, delay AS delay_min, CASE WHEN l2 = 'WARNING' AND delay < 5 THEN 'ADVISORY' ELSE l2 END AS level FROM f""")
def scan_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trip's spots to one severity: the worst spot's level, demoted by the floors of its delay."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(F.avg(F.col("l_discount") * 100).alias("jam"), F.max(F.col("l_discount") * 100).alias("worst"))
    delay = F.floor(F.col("worst") * 2).cast("int")
    return s.select("trip", F.round("jam", 4).alias("jam"), delay.alias("delay_min"), L.with_floors(L.level_jam10(F.col("worst")), delay).alias("level"))


@query("cq_trip_alert", "SELECT o_orderkey, round(coalesce(s.d, o_totalprice/10000 - 5) + 1e-9, 4) AS delay, CASE WHEN s.d IS NULL THEN 'enrich' ELSE 'scan' END AS source FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_tax*100) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON l_orderkey = o_orderkey")
def trip_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's delay where there is one, else the route's own difference."""
    s = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum(F.col("l_tax") * 100).alias("d"))
    j = table(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.round(F.coalesce("d", F.col("o_totalprice") / 10000 - 5) + 1e-9, 4).alias("delay"), F.when(F.col("d").isNull(), "enrich").otherwise("scan").alias("source"))
