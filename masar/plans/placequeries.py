"""Place-search queries: parts as places, nations as areas, and queries made of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masar.functions import text as X
from masar.operators import places as P
from masar.operators import placesearch as S
from masar.operators import routes as O
from masar.plans.geometry import hav
from masar.plans.registry import query, table

CITY = (30.05, 31.25)
_AT = "29.85::DOUBLE + ({k}*37 % 392)/1000.0::DOUBLE AS lat, 31.004::DOUBLE + ({k}*53 % 636)/1000.0::DOUBLE AS lng"
PARTS = f"(SELECT p_partkey AS id, 'rm:' || p_partkey AS pid, lower(p_type) AS scat, p_name AS name, p_brand AS brand, p_size/50.0::DOUBLE AS pop, {_AT.format(k='p_partkey')} FROM part)"
NATIONS = f"(SELECT n_nationkey, n_name, {_AT.format(k='n_nationkey')} FROM nation)"
#: The far kinds; the others are local.
FAR = {"economy": "walkable", "promo": "destination", "large": "landmark"}


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, and nations as areas, in the shape of S.PLACE."""
    none = F.lit(None).cast("string")
    p = O.placed(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), F.concat(F.lit("rm:"), F.col("p_partkey").cast("string")).alias("pid"), F.lit(0).alias("kind"), F.lower("p_type").alias("cat"), F.lower("p_type").alias("scat"), "lat", "lng", none.alias("name_ar"), F.col("p_name").alias("name_en"), none.alias("alt"), none.alias("addr"), F.col("p_brand").alias("brand"), none.alias("grp"), (F.col("p_size") / 50).alias("pop"), F.lit(0.8).alias("conf"), F.lit(0.0).alias("ext"))
    n = O.placed(table(spark, sf_dir, "nation"), "n_nationkey").select((F.col("n_nationkey") + 1_000_000_000_000).alias("id"), F.concat(F.lit("area:"), F.col("n_nationkey").cast("string")).alias("pid"), F.lit(1).alias("kind"), F.lit("city").alias("cat"), none.alias("scat"), "lat", "lng", none.alias("name_ar"), F.lower("n_name").alias("name_en"), none.alias("alt"), none.alias("addr"), none.alias("brand"), none.alias("grp"), F.lit(0.5).alias("pop"), F.lit(0.9).alias("conf"), F.lit(3000.0).alias("ext"))
    return p.union(n)


def lexicon(spark: SparkSession, sf_dir: str) -> P.Lexicon:
    """Part types as kinds, brands as chains, regions as landmarks; a row for each at most."""
    kinds = [r[0] for r in table(spark, sf_dir, "part").select(F.lower("p_type")).distinct().orderBy(F.lower("p_type")).collect()]
    brands = [r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    regions = sorted((r["r_regionkey"], r["r_name"].lower()) for r in table(spark, sf_dir, "region").collect())
    return P.load(
        [{"id": k, "proximity": FAR.get(k, "local"), "terms": {k: 1.0}} for k in kinds],
        [{"id": b, "category": kinds[0], "names": [b.lower().replace("#", " ")]} for b in brands],
        [P.Entity(f"r{k}", name, name, 29.9 + k / 20, 31.1 + k / 10, "landmark", 900.0) for k, name in regions],
        families={"economy": ("economy", "promo")},
    )


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each nation: names, a kind, a kind in an area, a chain, misspelt and half-typed words, and landmarks."""
    n = O.placed(table(spark, sf_dir, "nation"), "n_nationkey")
    k = F.col("n_nationkey") % 8
    q = (
        F.when(k == 0, "small widget").when(k == 1, "economy near me").when(k == 2, F.concat(F.lit("promo in "), F.lower("n_name"))).when(k == 3, "brand 13")
        .when(k == 4, "smal widgte").when(k == 5, "blue ro").when(k == 6, F.get(F.array(*map(F.lit, ("africa", "america", "asia", "europe", "middle east"))), (F.col("n_nationkey") % 5).cast("int"))).otherwise("large bolt")
    )
    return n.select(F.col("n_nationkey").alias("qid"), q.alias("q"), "lat", "lng")


@query("ps_lexicon", "SELECT DISTINCT lower(p_type) AS key, 'category' AS kind, lower(p_type) AS id FROM part UNION ALL SELECT DISTINCT replace(lower(p_brand), '#', ' '), 'brand', p_brand FROM part UNION ALL SELECT lower(r_name), 'landmark', 'r' || r_regionkey FROM region")
def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lx = lexicon(spark, sf_dir)
    rows = [(k, "category", c) for k, (c, _) in lx.categories.items()] + [(k, "brand", b) for k, (b, _) in lx.brands.items()] + [(k, e.kind, e.id) for k, e in lx.entities.items()]
    return spark.createDataFrame(rows, "key string, kind string, id string")


@query("ps_parse", """
SELECT n_nationkey AS qid, CASE k WHEN 0 THEN 'cat_name' WHEN 1 THEN 'category' WHEN 3 THEN 'brand' WHEN 4 THEN 'cat_name' ELSE 'name' END AS kind, CASE k WHEN 0 THEN 'small' WHEN 1 THEN 'economy' WHEN 4 THEN 'small' END AS scat, CASE WHEN k = 3 THEN 'Brand#13' END AS brand, k = 1 AS near,
       CASE k WHEN 0 THEN ['widget'] WHEN 1 THEN [] WHEN 3 THEN ['brand', '13'] WHEN 4 THEN ['widgte'] WHEN 5 THEN ['blue', 'ro'] WHEN 6 THEN string_split(['africa', 'america', 'asia', 'europe', 'middle east'][CAST(n_nationkey % 5 AS INTEGER) + 1], ' ') ELSE ['bolt'] END AS residual
FROM (SELECT *, n_nationkey % 8 AS k FROM nation) WHERE k NOT IN (2, 7)""")
def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of the queries without an area mean."""
    vocab = S.vocabulary(S.postings(S.place_tokens(places(spark, sf_dir)), S.forms(S.place_tokens(places(spark, sf_dir)))))
    p = P.parse(queries_of(spark, sf_dir), lexicon(spark, sf_dir), vocab)
    kind = F.when(F.col("p.brand").isNotNull() & ~F.col("p.beyond"), "brand").when(F.col("p.scat").isNotNull() & (F.size("p.residual") == 0), "category").when(F.col("p.scat").isNotNull(), "cat_name").otherwise("name")
    return p.filter("qid % 8 not in (2, 7)").select("qid", kind.alias("kind"), "p.scat", "p.brand", "p.near", "p.residual")


def found(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    return S.search(queries_of(spark, sf_dir), places(spark, sf_dir), lexicon(spark, sf_dir), limit)


@query("ps_search")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, 10).select("qid", "rank", "pid", "kind", F.round("score", 6).alias("score"))


@query("ps_typed")
def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times as many hits as wanted, of which those of a family of kinds."""
    r = found(spark, sf_dir, 15).filter(F.col("scat").isin("economy", "promo"))
    return r.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter("n <= 5").select("qid", "n", "pid")


@query("cq_autocomplete")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five suggestions around a point of the city."""
    q = queries_of(spark, sf_dir).withColumns({"lat": F.lit(CITY[0]), "lng": F.lit(CITY[1])})
    return S.search(q, places(spark, sf_dir), lexicon(spark, sf_dir), 5).select("qid", "rank", "pid", "name")


@query("cq_search_places")
def search_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to twenty hits, in the order of their distance."""
    r = found(spark, sf_dir, 20)
    return r.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("distance_m", "pid"))).select("qid", "n", "pid", F.round("distance_m", 1).alias("distance_m"))


_RING = f"""
WITH a AS (SELECT n_nationkey AS qid, lat AS alat, lng AS alng, CASE n_nationkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'large' ELSE 'medium' END AS scat FROM {NATIONS}),
m AS (SELECT *, CASE WHEN scat = 'large' THEN 100000.0 ELSE 40000.0 END AS cap, unnest(CASE WHEN scat = 'economy' THEN ['economy', 'promo'] ELSE [scat] END) AS member FROM a),
h AS (SELECT qid, cap, id, {hav('alat', 'alng', 'lat', 'lng')}*1000 AS d FROM m JOIN {PARTS} p ON p.scat = m.member),
r AS (SELECT qid, id, d, CAST(greatest(0, ceil(log2(greatest(d, 1)/3000))) AS INTEGER) AS ring FROM h WHERE greatest(0, ceil(log2(greatest(d, 1)/3000))) <= ceil(log2(cap/3000))),
c AS (SELECT qid, ring, sum(count(*)) OVER (PARTITION BY qid ORDER BY ring) - count(*) AS before FROM r GROUP BY qid, ring)
SELECT r.qid, r.id FROM r JOIN c USING (qid, ring) WHERE before < 12"""


@query("ps_category_ring", _RING)
def category_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a kind by doubling rings around each nation's point."""
    k = F.col("n_nationkey") % 3
    rows = O.placed(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("n_nationkey").alias("qid"), F.lit(0).alias("alt"), F.lit("category").alias("kind"), F.col("lat").alias("alat"), F.col("lng").alias("alng"), F.when(k == 0, "economy").when(k == 1, "large").otherwise("medium").alias("scat"), F.lit(None).cast("struct<radius:double>").alias("area"))
    return S.category_candidates(rows, places(spark, sf_dir), lexicon(spark, sf_dir)).select("qid", "id")


@query("ps_tau", f"SELECT p_partkey, (CASE lower(p_type) {' '.join(f'''WHEN '{k}' THEN {S.TAU[v]}::DOUBLE''' for k, v in FAR.items())} ELSE {S.TAU['local']}::DOUBLE END)*CASE WHEN p_size % 2 = 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS tau FROM part")
def tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.tau(F.lower("p_type"), F.col("p_size") % 2 == 0, lexicon(spark, sf_dir)).alias("tau"))


_KINDS = ("bank", "atm", "pharmacy", "mall", "cafe", "pizza", "gas_station", "oil_change", "hotel")


@query("ps_brand_family", f"""
WITH k AS (SELECT p_partkey, [{', '.join(f"'{x}'" for x in _KINDS)}][CAST(p_partkey % 9 AS INTEGER) + 1] AS a, [{', '.join(f"'{x}'" for x in _KINDS)}][CAST(p_size % 9 AS INTEGER) + 1] AS b FROM part)
SELECT p_partkey, a = b OR {' OR '.join(f"(a IN ({', '.join(repr(x) for x in f)}) AND b IN ({', '.join(repr(x) for x in f)}))" for f in S.BRAND_FAMILIES)} AS together FROM k""")
def brand_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda c: F.get(F.array(*map(F.lit, _KINDS)), (F.col(c) % 9).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.brand_family(kind("p_partkey"), kind("p_size")).alias("together"))


@query("ps_refine_area", f"""
WITH e AS (SELECT n_nationkey AS eid, n.lat AS elat, n.lng AS elng, list_sort(string_split(p.name, ' ')) AS w FROM {NATIONS} n JOIN {PARTS} p ON p.id = n.n_nationkey)
SELECT eid, arg_max(p.id, (p.pop, p.pid)) AS id FROM e JOIN {PARTS} p ON list_sort(string_split(p.name, ' ')) = e.w WHERE {hav('elat', 'elng', 'p.lat', 'p.lng')} <= 10 GROUP BY eid""")
def refine_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon point moves to the most popular place of its name near by: here each nation's, of the part of its number."""
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    e = O.placed(table(spark, sf_dir, "nation"), "n_nationkey").join(named, F.col("k") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("eid"), F.array("p_name").alias("names"), "lat", "lng", F.lit("landmark").alias("kind"))
    everywhere = places(spark, sf_dir).filter("kind = 0")
    moved = S.refine(e, everywhere).join(everywhere.select("id", F.col("lat").alias("y"), F.col("lng").alias("x"), "name_en", F.col("pop").alias("n"), "pid"), (F.col("lat") == F.col("y")) & (F.col("lng") == F.col("x")))
    own = e.select(F.col("eid").alias("oe"), F.col("names")[0].alias("own"))
    same = F.array_sort(F.split("name_en", " ")) == F.array_sort(F.split("own", " "))
    return moved.join(own, F.col("eid") == F.col("oe")).filter(same).groupBy("eid").agg(F.max_by("id", F.struct("n", "pid")).alias("id"))


@query("ps_entity_pin", "SELECT n_nationkey AS qid, 'lex:r' || (n_nationkey % 5) AS pid FROM nation WHERE n_nationkey % 8 = 6")
def entity_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks of the lexicon that no place has the name of answer with their own pin."""
    return found(spark, sf_dir, 1).filter(F.col("pid").startswith("lex:")).select("qid", "pid")


@query("tx_place_tokens", "SELECT id, t, joined FROM (SELECT id, unnest(string_split(name, ' ')) AS t, false AS joined FROM " + PARTS + ") UNION SELECT id, replace(name, ' ', ''), true FROM " + PARTS + " WHERE length(name) <= 13")
def place_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of names, and neighbours as one word where that is short."""
    return S.place_tokens(places(spark, sf_dir).filter("kind = 0")).select("id", "t", "joined").distinct()


@query("tx_index_terms")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index terms of some words of queries: own forms, completions, near skeletons and spellings."""
    tokens = S.place_tokens(places(spark, sf_dir))
    words = queries_of(spark, sf_dir).select(F.explode(X.tokens(X.normalize(F.col("q")))).alias("w"))
    known = S.forms(tokens.select("t").union(words))
    vocab = S.vocabulary(S.postings(tokens, known))
    return S.term_matches(words.withColumn("last", F.lit(True)), vocab, known).select("w", "term", "df")


@query("tx_word_match")
def word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of words of queries against the first words of names."""
    t = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("t")).distinct()
    w = spark.createDataFrame([("smal", False), ("widgte", False), ("blu", True), ("bolt", False), ("kold", False)], "w string, last boolean")
    pairs = w.join(t, F.length("t") > 0).withColumns({"first": F.lit(False), "joined": F.lit(False)})  # five words
    return S.word_quality(pairs, S.forms(t.union(w.select("w"))), frozenset({"bolt"})).select("w", "t", F.round("quality", 4).alias("quality"))


@query("agg_text_score")
def text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well "cold rod" fits each place, by rarity, quality and how much of the name it covers."""
    everywhere = places(spark, sf_dir).filter("kind = 0")
    tokens = S.place_tokens(everywhere)
    lists = spark.createDataFrame([(1, 0, 0, ["cold", "rod"])], "qid int, alt int, v int, words array<string>")
    known = S.forms(tokens.select("t").union(S.driving_words(lists)))
    candidates = everywhere.select(F.lit(1).alias("qid"), F.lit(0).alias("alt"), "id")
    scores = S.text_scores(candidates, lists, tokens, S.vocabulary(S.postings(tokens, known)), everywhere.count(), frozenset(), known)
    return scores.select("id", F.round("text", 6).alias("score"))


@query("cq_nearby", f"""
WITH h AS (SELECT n_nationkey, p.id, {hav('n.lat', 'n.lng', 'p.lat', 'p.lng')} AS d, row_number() OVER (PARTITION BY n_nationkey ORDER BY {hav('n.lat', 'n.lng', 'p.lat', 'p.lng')}, p.pid) AS n FROM {NATIONS} n JOIN {PARTS} p ON p.scat = CASE n_nationkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'large' ELSE 'medium' END)
SELECT n_nationkey AS qid, id, round(d, 5) AS km FROM h WHERE n <= 20""")
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest places of a kind, in the order of distance."""
    k = F.col("n_nationkey") % 3
    asked = O.placed(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("n_nationkey").alias("qid"), F.col("lat").alias("a"), F.col("lng").alias("b"), F.when(k == 0, "economy").when(k == 1, "large").otherwise("medium").alias("scat"))
    p = places(spark, sf_dir).filter("kind = 0").select("id", "pid", "scat", "lat", "lng")
    d = S.metres(F.col("a"), F.col("b"), F.col("lat"), F.col("lng"))
    hit = asked.join(p, "scat").withColumn("d", d).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("d", "pid")))
    return hit.filter("n <= 20").select("qid", "id", F.round(F.col("d") / 1000, 5).alias("km"))


def _pid(c: str) -> Column:
    return F.regexp_replace(c, "^rm:", "")


@query("cq_by_pid", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN (SELECT lower(r_name) FROM region WHERE r_regionkey = o_orderkey % 5) WHEN o_orderkey % 4 = 2 THEN NULL ELSE p_name END AS name FROM orders LEFT JOIN part ON p_partkey = o_orderkey AND o_orderkey % 4 < 2 WHERE o_orderkey % 4 >= 2 OR p_name IS NOT NULL")
def by_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by id, with or without their prefix, pins of the lexicon by theirs; an unknown id has no name."""
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 4 == 3, F.concat(F.lit("lex:r"), (k % 5).cast("string"))).when(k % 4 == 2, F.concat(F.lit("rm:none"), k.cast("string"))).when(k % 4 == 1, k.cast("string")).otherwise(F.concat(F.lit("rm:"), k.cast("string"))).alias("pid"))
    pins = table(spark, sf_dir, "region").select(F.concat(F.lit("lex:r"), F.col("r_regionkey").cast("string")).alias("key"), F.lower("r_name").alias("name"))
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"))
    out = asked.withColumn("k", _pid("pid")).join(pins.union(named), F.col("k") == F.col("key"), "left").select("o_orderkey", "name")
    return out.filter((F.col("o_orderkey") % 4 >= 2) | F.col("name").isNotNull())
