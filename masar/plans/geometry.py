"""Geometry, map-matching, graphs and route windows over suppliers, customers and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masar.functions import geo as G
from masar.operators import routes as O
from masar.operators import graph as GR
from masar.plans.registry import query, table

_HAV = "2*{r}*asin(sqrt(greatest(0::DOUBLE, least(1::DOUBLE, pow(sin(radians({c}-{a})/2),2) + cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)))))"


def hav(a: str, b: str, c: str, d: str, r: str = "6371.0::DOUBLE") -> str:
    return _HAV.format(a=a, b=b, c=c, d=d, r=r)


SUP = "(SELECT s_suppkey, s_nationkey, s_acctbal, 29.85::DOUBLE + (s_suppkey*37 % 392)/1000.0::DOUBLE AS lat, 31.004::DOUBLE + (s_suppkey*53 % 636)/1000.0::DOUBLE AS lng FROM supplier)"
CUS = "(SELECT c_custkey, c_nationkey, c_acctbal, 29.85::DOUBLE + (c_custkey*37 % 392)/1000.0::DOUBLE AS lat, 31.004::DOUBLE + (c_custkey*53 % 636)/1000.0::DOUBLE AS lng FROM customer)"
#: Order lines as route points; equal places in a route are told apart by what they hold.
PTS = "(SELECT l_orderkey AS route, l_suppkey AS junction, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos, 29.85::DOUBLE + (l_suppkey*37 % 392)/1000.0::DOUBLE AS lat, 31.004::DOUBLE + (l_suppkey*53 % 636)/1000.0::DOUBLE AS lng FROM lineitem)"
CUM = f"(SELECT *, sum(coalesce({hav('plat', 'plng', 'lat', 'lng')}, 0)) OVER (PARTITION BY route ORDER BY pos) AS cum FROM (SELECT *, lag(lat) OVER (PARTITION BY route ORDER BY pos) AS plat, lag(lng) OVER (PARTITION BY route ORDER BY pos) AS plng FROM {PTS}))"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.placed(table(spark, sf_dir, "supplier"), "s_suppkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.placed(table(spark, sf_dir, "customer"), "c_custkey")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(by))
    return O.placed(li, "l_suppkey").select(F.col("l_orderkey").alias("route"), F.col("l_suppkey").alias("junction"), "pos", "lat", "lng")


def along(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cumulative(points(spark, sf_dir), "route", ["pos"])


@query("fn_haversine", f"SELECT s_suppkey, round({hav('lat', 'lng', '30.05', '31.25')}, 5) AS km, round({hav('lat', 'lng', '30.05', '31.25', '6371000.0::DOUBLE')}, 2) AS m, round({hav('lat', 'lng', '30.05', '31.25', '6371008.8::DOUBLE')}, 2) AS place_m FROM {SUP}")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda r, n: F.round(G.haversine(F.col("lat"), F.col("lng"), F.lit(30.05), F.lit(31.25), r), n)
    return suppliers(spark, sf_dir).select("s_suppkey", d(G.RADIUS_KM, 5).alias("km"), d(G.RADIUS_M, 2).alias("m"), d(G.RADIUS_PLACE_M, 2).alias("place_m"))


@query("fn_project_param", f"""
WITH s AS (SELECT s_suppkey, lat, lng, cos(radians((29.9 + 30.2)/2)) AS c FROM {SUP}), t AS (SELECT s_suppkey, ((lng - 31.1)*c*(31.5 - 31.1)*c + (lat - 29.9)*(30.2 - 29.9)) / (pow((31.5 - 31.1)*c, 2) + pow(30.2 - 29.9, 2)) AS t FROM s)
SELECT s_suppkey, round(greatest(0, least(1, t)), 6) AS t, round(least(1, t), 6) AS open_t FROM t""")
def project_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.lit(x) for x in (29.9, 31.1, 30.2, 31.5)]
    return suppliers(spark, sf_dir).select("s_suppkey", F.round(G.project_param(*ends, F.col("lat"), F.col("lng")), 6).alias("t"), F.round(G.project_param(*ends, F.col("lat"), F.col("lng"), clamp_low=False), 6).alias("open_t"))


@query("fn_pt_seg_raw", f"""
WITH t AS (SELECT s_suppkey, lat, lng, greatest(0, least(1, ((lng - 31.1)*0.4 + (lat - 29.9)*0.3)/(0.4*0.4 + 0.3*0.3))) AS t FROM {SUP})
SELECT s_suppkey, round({hav('lat', 'lng', '(29.9 + t*0.3)', '(31.1 + t*0.4)', '6371000.0::DOUBLE')}, 2) AS m FROM t""")
def segment_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).select("s_suppkey", F.round(G.segment_distance_plain(F.lit(29.9), F.lit(31.1), F.lit(30.2), F.lit(31.5), F.col("lat"), F.col("lng")), 2).alias("m"))


@query("fn_latlon_tile", f"""
SELECT s_suppkey, CAST(floor((lng + 180)/360*8192) AS INTEGER) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*8192) AS INTEGER) AS y FROM {SUP}""")
def latlon_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).select("s_suppkey", G.tile_x(F.col("lng"), 13).alias("x"), G.tile_y(F.col("lat"), 13).alias("y"))


@query("fn_tile_bounds", "SELECT n_nationkey, round(n_nationkey/32.0::DOUBLE*360 - 180, 6) AS west, round(degrees(atan((exp(pi()*(1 - 2*n_nationkey/32.0::DOUBLE)) - exp(-pi()*(1 - 2*n_nationkey/32.0::DOUBLE)))/2)), 6) AS north FROM nation")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(G.tile_west(n, 5), 6).alias("west"), F.round(G.tile_north(n, 5), 6).alias("north"))


@query("fn_tile_latlon", "SELECT n_nationkey, round(-180 + (n_nationkey + 0.25)/32.0::DOUBLE*360, 6) AS lng, round(degrees(atan((exp(pi()*(1 - 2*(12 + 0.75)/32.0::DOUBLE)) - exp(-pi()*(1 - 2*(12 + 0.75)/32.0::DOUBLE)))/2)), 6) AS lat FROM nation")
def tile_latlon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a place within a tile lies: a quarter from the west and three from the north."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(G.tile_west(F.col("n_nationkey") + 0.25, 5), 6).alias("lng"), F.round(G.tile_north(F.lit(12.75), 5), 6).alias("lat"))


@query("fn_bbox_buffer", f"""
SELECT s_nationkey, round(min(lat) - 800/111320.0::DOUBLE, 6) AS south, round(max(lat) + 800/111320.0::DOUBLE, 6) AS north,
 round(min(lng) - 800/(111320.0::DOUBLE*greatest(0.1, cos(radians((min(lat)+max(lat))/2)))), 6) AS west, round(max(lng) + 800/(111320.0::DOUBLE*greatest(0.1, cos(radians((min(lat)+max(lat))/2)))), 6) AS east FROM {SUP} GROUP BY s_nationkey""")
def bbox_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = suppliers(spark, sf_dir).groupBy("s_nationkey").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lng").alias("c"), F.max("lng").alias("d"))
    dy, dx = 800 / G.METRES_PER_DEGREE, G.buffer_lng(800.0, (F.col("a") + F.col("b")) / 2)
    return b.select("s_nationkey", F.round(F.col("a") - dy, 6).alias("south"), F.round(F.col("b") + dy, 6).alias("north"), F.round(F.col("c") - dx, 6).alias("west"), F.round(F.col("d") + dx, 6).alias("east"))


@query("fn_edge_time", f"""
SELECT a.s_suppkey AS src, b.s_suppkey AS dst, round({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}/((CASE WHEN a.s_suppkey % 3 = 1 THEN 35 WHEN a.s_suppkey % 3 = 2 THEN 25 ELSE 28 END + CASE WHEN b.s_suppkey % 3 = 1 THEN 35 WHEN b.s_suppkey % 3 = 2 THEN 25 ELSE 28 END)/2.0::DOUBLE)*3600, 4) AS sec
FROM {SUP} a JOIN {SUP} b ON b.s_suppkey = a.s_suppkey + 1""")
def edge_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("src"), F.col("lat").alias("a"), F.col("lng").alias("b"))
    b = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("dst"), F.col("lat").alias("c"), F.col("lng").alias("d"))
    km = G.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return a.join(b, F.col("dst") == F.col("src") + 1).select("src", "dst", F.round(G.edge_seconds(km, G.tier_speed(F.col("src") % 3), G.tier_speed(F.col("dst") % 3)), 4).alias("sec"))


_NEAR = f"(SELECT c_custkey, s_suppkey, {hav('c.lat', 'c.lng', 's.lat', 's.lng')} AS km FROM {CUS} c, {SUP} s)"


@query("join_knn1", f"SELECT c_custkey, arg_min(s_suppkey, (km, s_suppkey)) AS s_suppkey, round(min(km), 5) AS km FROM {_NEAR} WHERE km <= 2.5 GROUP BY c_custkey")
def knn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.nearest(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 2.5).select("c_custkey", "s_suppkey", F.round("km", 5).alias("km"))


@query("agg_coverage", f"SELECT round(coalesce(count(DISTINCT c_custkey) FILTER (WHERE km <= 2.5) / (SELECT count(*) FROM customer)::DOUBLE, 0), 3) AS coverage FROM {_NEAR}")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    near = O.nearest(c, suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 2.5).select("c_custkey", F.lit(1.0).alias("hit"))
    return c.join(near, "c_custkey", "left").agg(F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)), 3).alias("coverage"))


@query("join_knn_k", f"""
SELECT s_suppkey, other, CAST(n AS BIGINT) AS n, round(km, 5) AS km FROM (SELECT a.s_suppkey, b.s_suppkey AS other, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS km,
 row_number() OVER (PARTITION BY a.s_suppkey ORDER BY {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.s_suppkey) AS n FROM {SUP} a JOIN {SUP} b ON a.s_suppkey <> b.s_suppkey) WHERE n <= 3 AND km <= 30""")
def knn_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.nearest_k(suppliers(spark, sf_dir), "s_suppkey", 3, 30.0).select("s_suppkey", "other", F.col("n").cast("long").alias("n"), F.round("km", 5).alias("km"))


@query("join_dist_theta", f"SELECT s_suppkey, round(min(km), 5) AS km FROM {_NEAR} WHERE km <= 1.5 GROUP BY s_suppkey")
def dist_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.nearest(suppliers(spark, sf_dir), customers(spark, sf_dir), "s_suppkey", "c_custkey", 1.5).select("s_suppkey", F.round("km", 5).alias("km"))


@query("join_corridor_ellipse", f"""
WITH d AS (SELECT s_suppkey, {hav('lat', 'lng', '29.9', '31.1')} AS a, {hav('lat', 'lng', '30.2', '31.5')} AS b, {hav('29.9', '31.1', '30.2', '31.5')} AS c FROM {SUP}),
e AS (SELECT s_suppkey, (a*a - b*b + c*c)/(2*c*c) AS frac, a, c FROM d)
SELECT s_suppkey, round(frac, 6) AS frac FROM e WHERE frac BETWEEN 0 AND 1 AND sqrt(greatest(0, a*a - frac*frac*c*c)) < 2.5""")
def corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a corridor between two points, from the distances to both alone."""
    lat, lng = F.col("lat"), F.col("lng")
    a, b = G.haversine(lat, lng, F.lit(29.9), F.lit(31.1)), G.haversine(lat, lng, F.lit(30.2), F.lit(31.5))
    c = G.haversine(F.lit(29.9), F.lit(31.1), F.lit(30.2), F.lit(31.5))
    frac = (a * a - b * b + c * c) / (2 * c * c)
    return suppliers(spark, sf_dir).withColumn("frac", frac).filter(F.col("frac").between(0, 1) & (F.sqrt(F.greatest(F.lit(0.0), a * a - F.col("frac") * F.col("frac") * c * c)) < 2.5)).select("s_suppkey", F.round("frac", 6).alias("frac"))


@query("win_cumdist", f"SELECT route, CAST(pos AS BIGINT) AS pos, round(cum, 5) AS km FROM {CUM}")
def cumdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return along(spark, sf_dir).select("route", F.col("pos").cast("long").alias("pos"), F.round("cum", 5).alias("km"))


@query("win_straight_eta", f"""
WITH c AS (SELECT *, max(cum) OVER (PARTITION BY route) AS total, count(*) OVER (PARTITION BY route) AS n FROM {CUM})
SELECT route, CAST(pos AS BIGINT) AS pos, round(CASE WHEN n = 1 THEN 900 ELSE cum/total*1800 END, 3) AS eta FROM c WHERE n = 1 OR total > 0""")
def straight_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the duration by distance; a lone point gets half of it, a route without length none."""
    by = Window.partitionBy("route")
    c = along(spark, sf_dir).withColumns({"total": F.max("cum").over(by), "n": F.count("*").over(by)})
    eta = F.when(F.col("n") == 1, 900.0).otherwise(F.col("cum") / F.nullif("total", F.lit(0.0)) * 1800)
    return c.filter("n = 1 or total > 0").select("route", F.col("pos").cast("long").alias("pos"), F.round(eta, 3).alias("eta"))


@query("win_dedupe_first", f"SELECT route, junction, CAST(min(pos) AS BIGINT) AS pos FROM {PTS} GROUP BY ALL")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("route", "junction").agg(F.min("pos").cast("long").alias("pos"))


@query("win_resample_2km", f"""
WITH l AS (SELECT route, cum, lat, lng, lead(cum) OVER w AS c2, lead(lat) OVER w AS a2, lead(lng) OVER w AS b2 FROM {CUM} WINDOW w AS (PARTITION BY route ORDER BY cum, pos)),
k AS (SELECT *, unnest(generate_series(CAST(ceil(cum/2) AS BIGINT), CAST(ceil(c2/2) AS BIGINT) - 1)) AS k FROM l WHERE c2 > cum)
SELECT route, k, round(lat + (k*2 - cum)/(c2 - cum)*(a2 - lat), 6) AS lat, round(lng + (k*2 - cum)/(c2 - cum)*(b2 - lng), 6) AS lng FROM k""")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point every 2 km along each route."""
    return O.densified(along(spark, sf_dir), "route", 2.0).select("route", "k", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("win_rings", f"""
WITH l AS (SELECT route, cum, lat, lng, lead(cum) OVER w AS c2, lead(lat) OVER w AS a2, lead(lng) OVER w AS b2 FROM {CUM} WINDOW w AS (PARTITION BY route ORDER BY cum, pos))
SELECT route, k, round(lat + (k*3 - cum)/(c2 - cum)*(a2 - lat), 6) AS lat, round(lng + (k*3 - cum)/(c2 - cum)*(b2 - lng), 6) AS lng FROM (SELECT *, unnest(generate_series(CAST(ceil(cum/3) AS BIGINT), CAST(ceil(c2/3) AS BIGINT) - 1)) AS k FROM l WHERE c2 > cum) WHERE k*3 <= 60""")
def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres of search rings: a point every 3 km of the first 60."""
    return O.densified(along(spark, sf_dir), "route", 3.0).filter("km <= 60").select("route", "k", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("win_densify", f"""
WITH l AS (SELECT route, pos, cum, lat, lng, lead(cum) OVER w AS c2, lead(lat) OVER w AS a2, lead(lng) OVER w AS b2 FROM {CUM} WINDOW w AS (PARTITION BY route ORDER BY cum, pos)),
n AS (SELECT *, CAST(CASE WHEN c2 > cum THEN ceil((c2 - cum)/0.4) ELSE 1 END AS BIGINT) AS n FROM l)
SELECT route, pos, step, round(lat + step/n::DOUBLE*(coalesce(a2, lat) - lat), 6) AS lat, round(lng + step/n::DOUBLE*(coalesce(b2, lng) - lng), 6) AS lng FROM (SELECT *, unnest(range(n)) AS step FROM n)""")
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of a route with others put between, so that none is over 400 m from the next."""
    return O.interposed(along(spark, sf_dir), "route", 0.4).select("route", F.col("pos").cast("long").alias("pos"), "step", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("win_greedy_min_gap", f"SELECT route, len(list_reduce(list_transform(list(cum ORDER BY cum), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 15.0 THEN list_concat(a, x) ELSE a END)) AS kept FROM {CUM} GROUP BY route")
def greedy_min_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = along(spark, sf_dir).groupBy("route").agg(F.array_sort(F.collect_list("cum")).alias("cums"))
    return lists.select("route", F.size(O.keep_by_gap(F.col("cums"), 15.0)).cast("long").alias("kept"))


@query("win_greedy_spacing", f"SELECT route, len(list_reduce(list_transform(list(CAST(pos AS DOUBLE) ORDER BY pos), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= greatest(1.0, n/20.0) AND len(a) < 10 THEN list_concat(a, x) ELSE a END)) AS kept FROM (SELECT *, count(*) OVER (PARTITION BY route) AS n FROM {PTS}) GROUP BY route, n")
def greedy_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By places in the route: a gap of a twentieth of its length, ten points at most."""
    lists = points(spark, sf_dir).groupBy("route").agg(F.array_sort(F.collect_list(F.col("pos").cast("double"))).alias("ps"), F.count("*").alias("n"))
    kept = F.aggregate("ps", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | ((x - F.element_at(a, -1) >= F.greatest(F.lit(1.0), F.col("n") / 20)) & (F.size(a) < 10)), F.concat(a, F.array(x))).otherwise(a))
    return lists.select("route", F.size(kept).cast("long").alias("kept"))


@query("win_sample_evenly", f"SELECT route, list(pos ORDER BY pos) FILTER (WHERE (pos - 1) % greatest(1, n // 3) = 0) AS picked FROM (SELECT route, CAST(pos AS INTEGER) AS pos, count(*) OVER (PARTITION BY route) AS n FROM {PTS}) GROUP BY route")
def sample_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("route"))
    rows = points(spark, sf_dir).withColumn("n", n).filter((F.col("pos") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / 3)) == 0)
    return rows.groupBy("route").agg(F.array_sort(F.collect_list("pos")).alias("picked"))


@query("win_line_points", f"""
WITH n AS (SELECT s_suppkey, lat, lng, greatest(2, CAST(floor({hav('lat', 'lng', '30.05', '31.25')}/1.5) AS BIGINT) + 1) AS n FROM {SUP})
SELECT s_suppkey, k, round(lat + k/(n - 1)::DOUBLE*(30.05 - lat), 6) AS lat, round(lng + k/(n - 1)::DOUBLE*(31.25 - lng), 6) AS lng FROM (SELECT *, unnest(range(n)) AS k FROM n)""")
def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the straight line from each junction to the city's middle, some 1.5 km apart, both ends included."""
    d = G.haversine(F.col("lat"), F.col("lng"), F.lit(30.05), F.lit(31.25))
    rows = suppliers(spark, sf_dir).withColumn("n", F.greatest(F.lit(2), F.floor(d / 1.5) + 1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    t = F.col("k") / (F.col("n") - 1)
    return rows.select("s_suppkey", "k", F.round(F.col("lat") + t * (30.05 - F.col("lat")), 6).alias("lat"), F.round(F.col("lng") + t * (31.25 - F.col("lng")), 6).alias("lng"))


@query("join_point_polyline", f"""
WITH c AS (SELECT s_suppkey, lat AS a, lng AS b FROM {SUP} WHERE s_suppkey % 50 = 7), d AS (SELECT s_suppkey, route, pos, cum, {hav('lat', 'lng', 'a', 'b')} AS km FROM {CUM}, c)
SELECT s_suppkey, route, CAST(arg_min(pos, (km, pos)) AS BIGINT) AS pos, round(arg_min(cum, (km, pos)), 5) AS along FROM d WHERE km <= 1 GROUP BY s_suppkey, route""")
def point_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For some places, each route that passes within a kilometre, by its nearest vertex; vertices and places meet in cells of the map."""
    c = suppliers(spark, sf_dir).filter("s_suppkey % 50 = 7").select("s_suppkey", F.col("lat").alias("a"), F.col("lng").alias("b"))
    near = O.near_pairs(along(spark, sf_dir), c, 1.0)
    best = near.groupBy("s_suppkey", "route").agg(F.min(F.struct("km", "pos", "cum")).alias("b"))
    return best.select("s_suppkey", "route", F.col("b.pos").cast("long").alias("pos"), F.round("b.cum", 5).alias("along"))


@query("fn_nearest_vertex", f"WITH d AS (SELECT route, pos, {hav('lat', 'lng', '30.05', '31.25', '6371000.0::DOUBLE')} AS m FROM {PTS}), v AS (SELECT route, arg_min(pos, (m, pos)) AS near, max(pos) AS n FROM d GROUP BY route) SELECT route, CAST(n - near + 1 AS BIGINT) AS remaining FROM v")
def nearest_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vertices are left from the one nearest to a point."""
    d = points(spark, sf_dir).withColumn("m", G.haversine(F.col("lat"), F.col("lng"), F.lit(30.05), F.lit(31.25), G.RADIUS_M))
    return d.groupBy("route").agg((F.max("pos") - F.min_by("pos", F.struct("m", "pos")) + 1).cast("long").alias("remaining"))


_SEG = f"(SELECT *, lead(lat) OVER w AS a2, lead(lng) OVER w AS b2, lead(cum) OVER w AS c2 FROM {CUM} WINDOW w AS (PARTITION BY route ORDER BY pos))"


@query("fn_project_point", f"""
WITH s AS (SELECT *, cos(radians((lat + a2)/2)) AS k FROM {_SEG} WHERE a2 IS NOT NULL),
t AS (SELECT *, CASE WHEN (b2-lng)*k = 0 AND a2 - lat = 0 THEN 0 ELSE ((31.25 - lng)*k*(b2 - lng)*k + (30.05 - lat)*(a2 - lat))/(pow((b2 - lng)*k, 2) + pow(a2 - lat, 2)) END AS t0 FROM s),
u AS (SELECT *, least(1, CASE WHEN pos = 1 THEN t0 ELSE greatest(0, t0) END) AS t FROM t),
v AS (SELECT route, pos, {hav('30.05', '31.25', '(lat + t*(a2-lat))', '(lng + t*(b2-lng))', '6371000.0::DOUBLE')} AS perp, cum + t*(c2 - cum) AS along FROM u)
SELECT route, round(min(perp), 2) AS perp, round(arg_min(along, (perp, pos)), 4) AS along FROM v GROUP BY route""")
def project_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to and place along each route; behind its start the place is negative."""
    by = Window.partitionBy("route").orderBy("pos")
    s = along(spark, sf_dir).withColumns({"a2": F.lead("lat").over(by), "b2": F.lead("lng").over(by), "c2": F.lead("cum").over(by)}).filter("a2 is not null")
    t = G.project_param(F.col("lat"), F.col("lng"), F.col("a2"), F.col("b2"), F.lit(30.05), F.lit(31.25), clamp_low=F.col("pos") > 1)
    s = s.withColumn("t", t)
    perp = G.haversine(F.lit(30.05), F.lit(31.25), F.col("lat") + F.col("t") * (F.col("a2") - F.col("lat")), F.col("lng") + F.col("t") * (F.col("b2") - F.col("lng")), G.RADIUS_M)
    best = s.withColumn("perp", perp).withColumn("along", F.col("cum") + F.col("t") * (F.col("c2") - F.col("cum"))).groupBy("route").agg(F.min(F.struct("perp", "pos", "along")).alias("b"))
    return best.select("route", F.round("b.perp", 2).alias("perp"), F.round("b.along", 4).alias("along"))


@query("join_tile_bbox", f"""
WITH t AS (SELECT s_nationkey AS tile, min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS d FROM {SUP} GROUP BY 1)
SELECT tile, round({hav('(a+b)/2', '(c+d)/2', '30.05', '31.25')}, 5) AS km FROM t WHERE a <= 30.1 AND b >= 30.0 AND c <= 31.3 AND d >= 31.2""")
def tile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = suppliers(spark, sf_dir).groupBy(F.col("s_nationkey").alias("tile")).agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lng").alias("c"), F.max("lng").alias("d"))
    km = G.haversine((F.col("a") + F.col("b")) / 2, (F.col("c") + F.col("d")) / 2, F.lit(30.05), F.lit(31.25))
    return t.filter("a <= 30.1 and b >= 30.0 and c <= 31.3 and d >= 31.2").select("tile", F.round(km, 5).alias("km"))


_EDGES = f"(SELECT a.s_suppkey AS src, b.s_suppkey AS dst, round({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}/28*3600, 3) AS sec FROM {SUP} a JOIN {SUP} b ON abs(a.s_suppkey - b.s_suppkey) IN (1, 7))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("src"), F.col("lat").alias("a"), F.col("lng").alias("b"), F.explode(F.array(*(F.lit(x) for x in (-7, -1, 1, 7)))).alias("step"))
    b = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("dst"), F.col("lat").alias("c"), F.col("lng").alias("d"))
    return a.join(b, F.col("dst") == F.col("src") + F.col("step")).select("src", "dst", F.round(G.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")) / 28 * 3600, 3).alias("sec"))


@query("gr_reverse_adj", f"SELECT dst, count(*) AS n, round(min(sec), 3) AS nearest FROM {_EDGES} GROUP BY dst")
def reverse_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.reverse_adjacency(edges(spark, sf_dir)).select("dst", F.size("sources").cast("long").alias("n"), F.array_min(F.transform("sources", lambda s: s["sec"])).alias("nearest"))


@query("set_edges_both_ways", f"SELECT src, dst, sec FROM {_EDGES} UNION ALL SELECT dst, src, sec FROM {_EDGES}")
def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.both_ways(edges(spark, sf_dir))


@query("gr_sssp_bounded", f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), p(node, sec, n) AS (SELECT 0::BIGINT, 0::DOUBLE, 0 UNION ALL
 SELECT src, min(p.sec + e.sec), n + 1 FROM p JOIN e ON e.dst = p.node WHERE p.sec + e.sec <= 15000 AND n < 40 GROUP BY src, n)
SELECT node, round(min(sec), 3) AS sec FROM p GROUP BY node""")
def sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse travel times to node 0 within a bound, by frontiers."""
    return GR.bounded_reverse(edges(spark, sf_dir), 0, 15000.0).select("node", F.round("sec", 3).alias("sec"))


@query("gr_upstream", f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), p(node, sec, n) AS (SELECT 0::BIGINT, 0::DOUBLE, 0 UNION ALL
 SELECT src, min(p.sec + e.sec), n + 1 FROM p JOIN e ON e.dst = p.node WHERE p.sec + e.sec <= 10000*1.25 + 60 AND n < 40 GROUP BY src, n),
b AS (SELECT node, min(sec) AS sec FROM p GROUP BY node)
SELECT node, round(sec, 3) AS sec, round(abs(sec - 10000), 3) AS delta FROM b WHERE node <> 0 AND abs(sec - 10000) <= 2500""")
def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose travel time to the target is within a quarter of the wanted one."""
    return GR.upstream(edges(spark, sf_dir), 0, 10000.0, 0.25).select("node", F.round("sec", 3).alias("sec"), F.round("delta", 3).alias("delta"))


@query("join_feeders", f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), p(node, sec, n) AS (SELECT 0::BIGINT, 0::DOUBLE, 0 UNION ALL
 SELECT src, min(p.sec + e.sec), n + 1 FROM p JOIN e ON e.dst = p.node WHERE p.sec + e.sec <= 6000*1.25 + 60 AND n < 40 GROUP BY src, n),
b AS (SELECT node, min(sec) AS sec FROM p GROUP BY node)
SELECT node, s_acctbal FROM b JOIN supplier ON s_suppkey = node WHERE node <> 0 AND abs(sec - 6000) <= 1500""")
def feeders(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = GR.upstream(edges(spark, sf_dir), 0, 6000.0, 0.25)
    return up.join(table(spark, sf_dir, "supplier"), F.col("node") == F.col("s_suppkey")).select("node", "s_acctbal")


@query("gr_build", f"""
WITH n AS (SELECT s_suppkey, other FROM (SELECT a.s_suppkey, b.s_suppkey AS other, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.s_suppkey) AS k FROM {SUP} a JOIN {SUP} b ON a.s_suppkey <> b.s_suppkey WHERE {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 30) WHERE k <= 3)
SELECT src, count(*) AS degree FROM (SELECT s_suppkey AS src FROM n UNION ALL SELECT other FROM n) GROUP BY src""")
def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours, both ways, duplicates kept."""
    near = O.nearest_k(suppliers(spark, sf_dir), "s_suppkey", 3, 30.0).select(F.col("s_suppkey").alias("src"), F.col("other").alias("dst"), F.col("km").alias("sec"))
    return GR.both_ways(near).groupBy("src").agg(F.count("*").alias("degree"))


@query("set_union_junctions", "SELECT s_suppkey AS key, 'real' AS kind, '' AS road FROM supplier UNION ALL SELECT n_nationkey, 'virtual', n_name FROM nation")
def union_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("real").alias("kind"))
    virtual = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.lit("virtual").alias("kind"), F.col("n_name").alias("road"))
    return real.unionByName(virtual, allowMissingColumns=True).withColumn("road", F.coalesce("road", F.lit("")))


@query("join_cross_slots", "SELECT o_orderkey, CAST(s AS INTEGER) AS slot, CAST(300 + 15*s AS INTEGER) AS minute FROM orders, range(76) t(s)")
def cross_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route with the 76 departures of a day, as a generator and not as a join."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(75))).alias("slot")).withColumn("minute", F.col("slot") * 15 + 300)
