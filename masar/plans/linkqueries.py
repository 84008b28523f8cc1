"""Queries of links: kept, read from parameters, shown in other maps, found in pages, guarded, and served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masar.functions import links as L
from masar.operators import linkstore as S
from masar.plans.geometry import SUP, suppliers
from masar.plans.registry import query, table


def _six(x: str) -> str:
    return f"regexp_replace(format('{{:.6f}}', {x}), '\\.?0+$', '')"


@query("prj_link_norm", """
SELECT event_id, CASE WHEN event_type = 'view' AND value <= 90 THEN 'coordinate' WHEN event_type = 'click' AND value <= 90 THEN 'place' WHEN event_type = 'purchase' THEN 'query' WHEN event_type = 'signup' AND value <= 90 THEN 'route' END AS kind,
  CASE WHEN event_type IN ('view', 'click', 'signup') AND value <= 90 THEN value END AS lat, CASE WHEN event_type = 'click' AND value <= 90 THEN 'user ' || user_id WHEN event_type = 'purchase' THEN 'q' || event_id WHEN event_type = 'signup' AND value <= 90 THEN 'Route' WHEN event_type = 'view' AND value <= 90 THEN 'Shared location' END AS title FROM events""")
def link_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of four kinds from their JSON; a point off the earth and an unknown kind make none."""
    e = table(spark, sf_dir, "events")
    point = F.struct(F.col("value").alias("lat"), F.lit(31.25).alias("lng"))
    kind = F.when(F.col("event_type") == "view", "coordinate").when(F.col("event_type") == "click", "place").when(F.col("event_type") == "purchase", "query").when(F.col("event_type") == "signup", "route").otherwise("live")
    raw = F.to_json(F.struct(kind.alias("kind"), point.alias("point"), F.concat(F.lit(" user "), F.col("user_id").cast("string"), F.lit("\n")).alias("label"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query"), F.struct(point.alias("point")).alias("destination")))
    link = L.normalised(raw)
    return e.select("event_id", link.alias("l")).select("event_id", "l.kind", L.point_of(F.col("l"))["lat"].alias("lat"), F.when(F.col("l").isNotNull(), L.title_of(F.col("l"), F.lit("en"))).alias("title"))


@query("prj_link_go", f"""
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'place' WHEN 1 THEN 'coordinate' WHEN 2 THEN 'route' WHEN 3 THEN 'query' END AS kind, CASE s_suppkey % 5 WHEN 2 THEN 'walking' END AS profile, CASE WHEN s_suppkey % 5 < 3 THEN round(lat, 4) END AS lat FROM {SUP}""")
def link_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of query parameters."""
    k, lat, lng = F.col("s_suppkey") % 5, F.round("lat", 4).cast("string"), F.round("lng", 4).cast("string")
    text = F.when(k == 0, F.concat(F.lit("lat="), lat, F.lit("&lng="), lng, F.lit("&name=x"))).when(k == 1, F.concat(F.lit("ll="), lat, F.lit(","), lng, F.lit("&z=12"))).when(k == 2, F.concat(F.lit("kind=route&mode=walk&d="), lat, F.lit(","), lng, F.lit("&w=30,31|Giza"))).when(k == 3, F.lit("kind=q&text=Cairo Tower")).otherwise(F.lit("lat=999&lng=1"))
    return suppliers(spark, sf_dir).withColumn("l", L.from_parameters(F.str_to_map(text, F.lit("&"), F.lit("=")))).select("s_suppkey", "l.kind", "l.profile", L.point_of(F.col("l"))["lat"].alias("lat"))


@query("prj_link_urls", f"SELECT s_suppkey, 'https://www.google.com/maps/search/?api=1&query=' || ll AS google, 'https://maps.apple.com/?ll=' || ll || '&q=S' || s_suppkey AS apple, 'https://waze.com/ul?ll=' || ll || '&navigate=yes' AS waze FROM (SELECT s_suppkey, {_six('lat')} || '%2C' || {_six('lng')} AS ll FROM {SUP})")
def link_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.lit("place").alias("kind"), F.struct("lat", "lng").alias("point"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("label")))
    return suppliers(spark, sf_dir).select("s_suppkey", L.other_maps(L.normalised(raw)).alias("m")).select("s_suppkey", "m.*")


@query("prj_link_point_title", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name WHEN p_size > 10 THEN p_brand ELSE 'مسار' END AS title, CASE WHEN p_size <= 10 THEN 30.0::DOUBLE WHEN p_size > 25 THEN 29.0::DOUBLE END AS lat FROM part")
def link_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links are about, and what they are called."""
    point = lambda x: F.struct(F.lit(x).alias("lat"), F.lit(31.0).alias("lng"))
    place = F.to_json(F.struct(F.lit("place").alias("kind"), point(29.0).alias("point"), F.col("p_name").alias("label")))
    asked = F.to_json(F.struct(F.lit("query").alias("kind"), F.col("p_brand").alias("query")))
    route = F.to_json(F.struct(F.lit("route").alias("kind"), F.struct(point(30.0).alias("point")).alias("destination")))
    link = L.normalised(F.when(F.col("p_size") > 25, place).when(F.col("p_size") > 10, asked).otherwise(route))
    return table(spark, sf_dir, "part").withColumn("l", link).select("p_partkey", L.title_of(F.col("l"), F.lit("ar")).alias("title"), L.point_of(F.col("l"))["lat"].alias("lat"))


_PAGE = "CASE page_id % 4 WHEN 0 THEN '!3d30.5!4d31.25' WHEN 1 THEN '<meta property=\"og:image\" content=\"x?center=30.25%2C31.5&z=1\">' WHEN 2 THEN '{\"latitude\": 30.125, \"longitude\": 31.75}' ELSE '' END"


@query("tx_html_extract", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 30.5 WHEN 1 THEN 30.25 WHEN 2 THEN 30.125 END::DOUBLE AS lat, CASE WHEN page_id % 4 < 3 THEN nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?i)<title[^>]*>([^<]{1,200})</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s*[-–|·]\\s*Google Maps.*$', '')), '') END AS title FROM pages")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and titles of pages, by the first way of writing one that a page has."""
    return table(spark, sf_dir, "pages").select("page_id", L.from_page(F.concat("html", F.expr(_PAGE))).alias("l")).select("page_id", "l.point.lat", F.col("l.label").alias("title"))


_URL = "CASE page_id % 7 WHEN 0 THEN 'https://maps.app.goo.gl/' || page_id WHEN 1 THEN url WHEN 2 THEN 'ftp://google.com/x' WHEN 3 THEN 'https://me:pw@google.com/' WHEN 4 THEN 'https://www.google.com:8443/' WHEN 5 THEN 'https://Maps.Google.com.eg/x' ELSE 'https:///nothing' END"


@query("tx_url_guard", "SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'host_not_allowed' WHEN 2 THEN 'scheme_not_allowed' WHEN 3 THEN 'credentials_in_url' WHEN 4 THEN 'port_not_allowed' WHEN 6 THEN 'no_host' END AS error, (page_id % 256 NOT IN (0, 10, 127) AND page_id % 256 < 224) AS public FROM pages")
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a URL mustn't be followed, and whether an address is public."""
    ip = F.concat((F.col("page_id") % 256).cast("string"), F.lit(".1.2.3"))
    return table(spark, sf_dir, "pages").select("page_id", L.url_error(F.expr(_URL)).alias("error"), L.is_public_ip(ip).alias("public"))


@query("cq_html_continue", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.google.com/maps?p=' || page_id || '&x=1' END AS target FROM pages")
def html_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.concat(F.lit('<input name="continue" value="https://www.google.com/maps?p='), F.col("page_id").cast("string"), F.lit('&amp;x=1">'))
    return table(spark, sf_dir, "pages").select("page_id", L.continue_url(F.concat("html", F.when(F.col("page_id") % 3 == 0, field).otherwise("")), F.col("url")).alias("target"))


@query("tx_ids", "SELECT page_id, true AS ok FROM pages")
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fresh id is eight letters and digits; ids themselves are random."""
    return table(spark, sf_dir, "pages").select("page_id", L.new_id(8).rlike("^[A-Za-z0-9]{8}$").alias("ok"))


@query("cq_links", """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 = 4 AS bad, o_orderkey % 2 = 1 AS own, o_orderkey % 3 AS days FROM orders)
SELECT k*4 AS seq, CASE WHEN bad THEN 422 ELSE 201 END AS status FROM o UNION ALL SELECT k*4 + 1, CASE WHEN bad THEN 404 WHEN days = 1 THEN 410 ELSE 200 END FROM o
UNION ALL SELECT k*4 + 2, CASE WHEN bad THEN 404 WHEN own THEN 200 ELSE 403 END FROM o UNION ALL SELECT k*4 + 3, CASE WHEN bad THEN 404 WHEN own OR days > 0 THEN 410 ELSE 200 END FROM o""")
def links_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four requests for each order's link: mint, get after a day and a half, revoke with or without the right token, get after a week."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("t"))
    body = F.when(F.col("k") % 5 == 4, '{"kind":"place"}').otherwise('{"kind":"query","query":"x"}')
    key = F.col("k").cast("string")

    def request(n: int, op: str, token: object, after: str) -> DataFrame:
        return o.select((F.col("k") * 4 + n).alias("seq"), F.lit(op).alias("op"), key.alias("id"), token.alias("token"), body.alias("body"), (F.col("k") % 3 * 86_400).alias("ttl_seconds"), (F.col("t") + F.expr(f"INTERVAL {after}")).alias("at"))

    own = F.when(F.col("k") % 2 == 1, key).otherwise("wrong")
    log = request(0, "mint", key, "0 HOURS").union(request(1, "get", F.lit(None).cast("string"), "36 HOURS")).union(request(2, "revoke", own, "37 HOURS")).union(request(3, "get", F.lit(None).cast("string"), "168 HOURS"))
    return S.links_served(log).select("seq", "status")


_LIVE = """
WITH s AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'signup') AS stop FROM events GROUP BY user_id)
SELECT CAST(s.user_id AS VARCHAR) AS id, arg_max(value, event_id) FILTER (WHERE event_type IN ('view', 'click', 'purchase') AND (stop IS NULL OR event_id < stop)) AS lat, any_value(stop IS NOT NULL) AS ended FROM events JOIN s USING (user_id) GROUP BY s.user_id"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's trip: progress at each event, with a wrong token at errors, ended at the first signup."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    start = e.select("user_id").distinct().select(F.lit(-1).cast("long").alias("seq"), F.lit("start").alias("op"), user.alias("id"), user.alias("token"), F.lit('{"label":"x"}').alias("body"), F.lit(3600).cast("long").alias("ttl_seconds"), at.alias("at"))
    op = F.when(F.col("event_type") == "signup", "end").otherwise("progress")
    rest = e.select(F.col("event_id").alias("seq"), op.alias("op"), user.alias("id"), F.when(F.col("event_type") == "error", "wrong").otherwise(user).alias("token"), F.to_json(F.struct(F.col("value").alias("lat"), F.lit(31.0).alias("lng"))).alias("body"), F.lit(None).cast("long").alias("ttl_seconds"), at.alias("at"))
    return S.live_trips(start.union(rest)).select("id", "lat", "ended")


@query("sink_link_crud", _LIVE)
def link_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir)


@query("st_live_trip", _LIVE)
def live_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir)
