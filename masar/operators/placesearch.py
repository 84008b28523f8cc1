"""Place search: an inverted index of places, and queries over it from words to ranked places.

``search`` runs all readings of a query side by side (as parsed; without the area that its last words may name; with two words as one; with the kind's words
as a name) and keeps the first that finds anything.  Words become index terms by joins with the vocabulary, terms become
candidates by joins with the postings of the rarest words, and the fit of words to a candidate's tokens is worked out once for each pair of a word and a
token, not for each candidate.  Limits are the engine's own: postings of a term, candidates of a query, results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masar.functions import geo as G
from masar.functions import text as X
from masar.operators import places as P
from masar.operators import search as S
from masar.operators.lineage import cut

# Weights of text, nearness, popularity, confidence and kind, and the scales of the engine.
WEIGHTS = {"name": (0.52, 0.14, 0.24, 0.10, 0.0), "category": (0.04, 0.52, 0.24, 0.14, 0.06), "cat_name": (0.46, 0.16, 0.12, 0.08, 0.18), "brand": (0.16, 0.56, 0.10, 0.14, 0.04), "area": (0.60, 0.10, 0.30, 0.0, 0.0), "street": (0.48, 0.34, 0.10, 0.08, 0.0)}
QUALITY = {"word": 1.0, "stem": 0.96, "join": 0.92, "loose": 0.84, "skeleton": 0.78, "skeleton2": 0.55, "skeleton_prefix": 0.58, "skeleton_fuzzy": 0.62, "prefix_least": 0.58, "prefix_most": 0.94, "typo1": 0.72, "typo2": 0.56}
FIELDS = (1.0, 0.88, 0.45)
TAU = {"walkable": 900.0, "local": 2500.0, "destination": 9000.0, "landmark": 30000.0}
BRAND_FAMILIES = (("bank", "atm", "exchange"), ("pharmacy",), ("supermarket", "mall", "market"), ("mobile_shop", "electronics_store", "appliance_store"), ("gas_station", "car_repair", "oil_change", "ev_charging"), ("restaurant", "fast_food", "burger", "pizza", "grill", "koshary", "cafe", "sweets", "bakery", "juice_bar", "ice_cream"))
COMPLETIONS, TYPO_TERMS, RARE_DF, POSTINGS, CANDIDATES, FIRST_WORD, COVERAGE, EXACT = 48, 6, 2500, 4000, 3000, 0.04, 0.25, 0.10
TEXT_M, RING_M, RING_CAP_M, RING_LEAST, BRAND_M, REFINE_M, SAME_M = 60_000.0, 3000.0, 40_000.0, 12, 25_000.0, 10_000.0, 150.0
PLACE = "id long, pid string, kind int, cat string, scat string, lat double, lng double, name_ar string, name_en string, alt string, addr string, brand string, grp string, pop double, conf double, ext double"


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return G.haversine(lat1, lng1, lat2, lng2) * 1000


def _plain(text: Column) -> Column:
    return F.filter(X.tokens(X.normalize(text)), lambda t: ~X.is_stop(t))


def place_tokens(places: DataFrame) -> DataFrame:
    """(id, t, field, first, joined, name): the tokens of names, other names (parted by U+001F) and addresses, and short pairs of neighbours as one."""
    each = [(0, "name_ar"), (0, "name_en"), (1, "alt"), (2, "addr")]

    def parted(k: int) -> Column:
        field, column = each[k]
        return F.transform(F.split(F.coalesce(F.col(column), F.lit("")), "\x1f"), lambda part: F.struct(F.lit(field).alias("field"), F.lit(k).alias("name"), _plain(part).alias("ts")))

    parts = F.flatten(F.array(*map(parted, range(len(each)))))
    rows = places.select("id", F.explode(parts).alias("p")).filter(F.size("p.ts") > 0)
    single = F.transform("p.ts", lambda t, i: F.struct(t.alias("t"), (i == 0).alias("first"), F.lit(False).alias("joined")))
    pairs = F.transform(F.filter(F.zip_with(F.slice("p.ts", F.lit(1), F.size("p.ts") - 1), F.slice("p.ts", F.lit(2), F.size("p.ts") - 1), lambda a, b: F.concat(a, b)), lambda t: F.char_length(t) <= 12), lambda t: F.struct(t.alias("t"), F.lit(False).alias("first"), F.lit(True).alias("joined")))
    both = F.when(F.col("p.field") < 2, F.concat(single, pairs)).otherwise(single)
    return rows.select("id", F.col("p.field").alias("field"), F.col("p.name").alias("name"), F.explode(both).alias("x")).select("id", "x.t", "field", "x.first", "x.joined", "name").distinct()


def forms(words: DataFrame) -> DataFrame:
    """(t, stem, loose, bones, edits) of each distinct token (t): worked out once, and kept, as many steps ask for them."""
    bones = F.filter(S.skeletons("t"), lambda s: (F.char_length(s) >= 2) & ~s.rlike("^[0-9]+$"))
    return cut(words.select("t").distinct().select("t", F.coalesce(X.stem(F.col("t")), "t").alias("stem"), X.loose(F.col("t")).alias("loose"), bones.alias("bones"), X.max_edits(F.col("t")).alias("edits")))


def _terms(most: int) -> Column:
    return F.array_distinct(F.concat(F.array("t", "stem"), F.transform(F.slice("bones", 1, most), lambda s: F.concat(F.lit("~"), s))))


def postings(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(term, id, field): each token, its stem and its skeletons (after ``~``)."""
    return tokens.join(known.select("t", F.explode(_terms(S.MOST_VARIANTS)).alias("term")), "t").groupBy("term", "id").agg(F.min("field").alias("field"))


def vocabulary(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def _core(name: Column) -> Column:
    """The stems of a name without stop words, sorted, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(_plain(name), lambda t: F.coalesce(X.stem(t), t)))), " ")


def cores(places: DataFrame) -> DataFrame:
    """(id, core, whole): the names' stems without words like city or village, and all of them."""
    names = places.select("id", F.explode(F.array_compact(F.array("name_ar", "name_en"))).alias("n")).select("id", F.split(_core(F.col("n")), " ").alias("w"))
    return names.select("id", F.array_join(F.filter("w", lambda t: ~t.isin(*P.AREA_WORDS)), " ").alias("core"), F.array_join("w", " ").alias("whole")).distinct()


def refine(entities: DataFrame, places: DataFrame) -> DataFrame:
    """(eid, lat, lng): an entity's point moves to the most popular place of one of its names within ``REFINE_M``.

    entities: (eid, names array, lat, lng, kind).  Roads and entities without such a place aren't in the result.
    """
    named = entities.filter("kind <> 'road'").select("eid", F.col("lat").alias("elat"), F.col("lng").alias("elng"), F.explode("names").alias("n")).select("eid", "elat", "elng", _core(F.col("n")).alias("whole")).distinct()
    hits = named.join(cores(places).select("id", "whole"), "whole").join(places.select("id", "lat", "lng", "pop", "pid"), "id")
    near = hits.filter(metres(F.col("elat"), F.col("elng"), F.col("lat"), F.col("lng")) <= REFINE_M)
    return near.groupBy("eid").agg(F.max(F.struct(F.col("pop"), F.col("pid"), F.col("lat"), F.col("lng"))).alias("b")).select("eid", "b.lat", "b.lng")


def areas_named(parsed: DataFrame, places: DataFrame) -> DataFrame:
    """(qid, start, n, led, area): of the windows that name an area, the longest, then the led, then the near and popular one.

    Without a leading word an area counts only near by, or if it is a town and its whole name was said; a small one only nearer still.
    """
    w = parsed.select("qid", F.col("lat").alias("qlat"), F.col("lng").alias("qlng"), F.explode("p.windows").alias("w")).select("qid", "qlat", "qlng", "w.*").filter("core <> ''")
    named = places.filter("kind = 1").join(cores(places), "id").select("core", "whole", "id", "lat", "lng", "cat", "pop", "ext", F.coalesce("name_ar", "name_en").alias("name"))
    d = metres(F.col("qlat"), F.col("qlng"), F.col("lat"), F.col("lng"))
    hit = w.join(named, "core").withColumns({"d": d, "full": F.col("whole") == F.col("all_words")})
    far = (F.col("d") > 40_000) & (~F.col("full") | ~F.coalesce("cat", F.lit("")).isin("city", "governorate", "markaz", "town"))
    small = F.coalesce("cat", F.lit("")).isin("neighbourhood", "hamlet", "village") & (F.col("d") > 15_000)
    fit = hit.filter("led").unionByName(hit.filter(~F.col("led") & ~far & ~small))
    order = F.struct(-F.col("n"), ~F.col("led"), F.col("d") / (1 + 0.5 * F.coalesce("pop", F.lit(0.0))), "id", "start")
    area = F.struct("name", "lat", "lng", F.greatest(F.lit(1500.0), F.least(F.lit(15_000.0), F.coalesce(F.nullif("ext", F.lit(0.0)), F.lit(2500.0)))).alias("radius"), F.lit(False).alias("road"))
    best = fit.groupBy("qid").agg(F.min_by(F.struct("start", "n", "led", area.alias("area")), order).alias("b"))
    return best.select("qid", "b.*")


def readings(parsed: DataFrame, places: DataFrame) -> DataFrame:
    """(qid, alt, q columns, p, residual, area, kind): the readings of each query, the best first."""
    found = areas_named(parsed, places).select(F.col("qid").alias("aq"), "start", "n", "led", F.col("area").alias("found"))
    rows = parsed.join(found, F.col("qid") == F.col("aq"), "left").drop("aq")
    p = F.col("p")
    inside = lambda i: (i >= F.col("start")) & (i < F.col("start") + F.col("n"))
    word = lambda i: F.get(p["toks"], i)
    gone = lambda i: (F.coalesce(inside(i), F.lit(False)) & ~p["typed"]) | (word(i).isin(*P.IN_WORDS) & (F.size(p["toks"]) > 1)) | X.is_stop(word(i))
    left = F.filter(p["free"], lambda i, at: (at < p["brand_n"]) | ~gone(i))  # a chain's own words come first and stay
    with_area = F.when(F.col("found").isNotNull(), F.transform(left, word)).otherwise(p["residual"])
    kind_of = lambda residual, beyond, scat: F.when(p["brand"].isNotNull() & ~beyond, "brand").when(scat.isNotNull() & (F.size(residual) == 0), "category").when(scat.isNotNull(), "cat_name").otherwise("name")
    others = F.filter(with_area, lambda t, at: (at >= p["brand_n"]) & ~t.isin(*P.STREET_WORDS))
    beyond = F.when(F.col("found").isNotNull(), F.size(others) > 0).otherwise(p["beyond"])
    scope = F.when(F.col("found").isNotNull() & (p["scope"] == "anchor"), "in_area").otherwise(p["scope"])
    base = rows.withColumns({"alt": F.lit(0), "residual": with_area, "area": F.coalesce(p["area"], F.col("found")), "scope": scope, "scat": p["scat"], "kind": kind_of(with_area, beyond, p["scat"])})
    again = rows.filter("found is not null and not led").withColumns({"alt": F.lit(1), "residual": p["residual"], "area": p["area"], "scope": p["scope"], "scat": p["scat"], "kind": kind_of(p["residual"], p["beyond"], p["scat"])})
    two = base.unionByName(again)
    r = F.col("residual")
    one, other = F.get(r, F.lit(0)), F.get(r, F.lit(1))
    arabic = lambda t: t.rlike(f"[{X.ARABIC}]")
    joined = two.filter((F.col("kind") == "name") & (F.size(r) == 2)).filter((F.char_length(one) + F.char_length(other) <= 12) & (arabic(one) == arabic(other))).withColumns({"alt": F.col("alt") + 2, "residual": F.array(F.concat(one, other))})
    as_name = two.filter((F.col("kind") == "category") & (F.size(p["cat_words"]) > 0)).withColumns({"alt": F.col("alt") + 4, "residual": F.filter(p["cat_words"], lambda t: ~X.is_stop(t)), "scat": F.lit(None).cast("string"), "kind": F.lit("name")})
    return two.unionByName(joined).unionByName(as_name).drop("start", "n", "led", "found")


def term_matches(words: DataFrame, vocab: DataFrame, known: DataFrame) -> DataFrame:
    """(w, last, term, df): the index terms of each distinct word.

    Its own forms; its completions where it is the last word; and where nothing else is there, near skeletons and near spellings.
    """
    w = cut(words.select(F.col("w").alias("t"), "last").distinct().join(known, "t"))
    v = vocab.withColumn("head", F.substring("term", 1, 2))
    own = w.select("t", "last", F.explode(_terms(2)).alias("term")).join(vocab, "term").select("t", "last", "term", "df")
    starts = w.filter(F.col("last") & (F.char_length("t") >= 2)).select("t", "last", F.col("t").alias("start"), F.lit(COMPLETIONS).alias("most"))
    bones = w.filter("last and size(bones) > 0 and char_length(get(bones, 0)) >= 3").select("t", "last", F.concat(F.lit("~"), F.get("bones", F.lit(0))).alias("start"), F.lit(COMPLETIONS // 2).alias("most"))
    wide = starts.union(bones).withColumn("head", F.substring("start", 1, 2)).join(v, "head").filter(F.col("term").startswith(F.col("start")) & (F.col("term") != F.col("start")))
    grown = wide.withColumn("r", F.row_number().over(Window.partitionBy("t", "start").orderBy(F.desc("df"), "term"))).filter("r <= most").select("t", "last", "term", "df")
    found = cut(own.union(grown).distinct())
    none = w.join(found.select("t", "last").distinct(), ["t", "last"], "left_anti").filter("size(bones) > 0 and char_length(get(bones, 0)) >= 4").withColumn("bone", F.get("bones", F.lit(0)))
    skeletal = none.withColumn("head", F.substring(F.concat(F.lit("~"), "bone"), 1, 2)).join(v, "head").filter(F.char_length("term").between(F.char_length("bone"), F.char_length("bone") + 2))
    near = skeletal.withColumn("e", S.osa(F.col("bone"), F.expr("substring(term, 2)"), 1)).filter("e <= 1").select("t", "last", "term", "df")
    found = cut(found.union(near))
    spelt = found.filter(~F.col("term").startswith("~")).select("t", "last").distinct()
    missed = w.join(spelt, ["t", "last"], "left_anti").withColumn("budget", X.max_edits(F.col("stem"))).filter("char_length(t) >= 3 and budget > 0")
    typo = missed.withColumn("h", F.substring("stem", 1, 1)).join(vocab.withColumn("h", F.substring("term", 1, 1)), "h").filter(F.abs(F.char_length("term") - F.char_length("stem")) <= F.col("budget"))
    ranked = typo.withColumn("e", S.osa(F.col("stem"), F.col("term"), 2)).filter("e <= budget").withColumn("r", F.row_number().over(Window.partitionBy("t", "last").orderBy("e", F.desc("df"), "term")))
    return found.union(ranked.filter(f"r <= {TYPO_TERMS}").select("t", "last", "term", "df")).distinct().withColumnRenamed("t", "w")


def text_candidates(lists: DataFrame, posted: DataFrame, vocab: DataFrame, places: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, alt, id): places that hold the rarest words of a list of words (qid, alt, v, lat, lng, words), near the query first.

    The two rarest words drive, each with ``RARE_DF`` places or fewer, or the one rarest; where even that is common, the places that hold both.
    """
    at = lists.select("qid", "alt", "v", "lat", "lng", F.size("words").alias("n"), F.posexplode("words").alias("i", "w")).withColumn("last", F.col("i") == F.col("n") - 1)
    per = cut(at.join(term_matches(at, vocab, known), ["w", "last"]))
    total = cut(per.groupBy("qid", "alt", "v", "i").agg(F.sum("df").alias("total")).withColumn("r", F.row_number().over(Window.partitionBy("qid", "alt", "v").orderBy("total", "i"))))
    drivers = total.filter(f"r = 1 or (r = 2 and total <= {RARE_DF})")
    both = total.filter("r <= 2").groupBy("qid", "alt", "v").agg(F.count("*").alias("c"), F.min("total").alias("least")).filter(f"c = 2 and least > {RARE_DF}").select("qid", "alt", "v")
    near = places.select("id", F.col("lat").alias("plat"), F.col("lng").alias("plng"))

    def hits(which: DataFrame, at_most: int | None) -> DataFrame:
        rows = which.join(per.select("qid", "alt", "v", "i", "lat", "lng", "term"), ["qid", "alt", "v", "i"]).join(posted, "term").join(near, "id")
        rows = rows.withColumn("d", metres(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))).filter(F.col("d") <= TEXT_M)
        if at_most:
            rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("qid", "alt", "v", "i", "term").orderBy("d", "id"))).filter(F.col("k") <= at_most)
        return rows

    single = hits(drivers, POSTINGS).groupBy("qid", "alt", "v", "id").agg(F.sum(F.when(F.col("field") == 0, 1.0).otherwise(0.6)).alias("pre"), F.min("d").alias("d"))
    pairs = hits(total.filter("r <= 2").join(both, ["qid", "alt", "v"]), None).groupBy("qid", "alt", "v", "id").agg(F.count_distinct("i").alias("c"), F.min("d").alias("d")).filter("c = 2").select("qid", "alt", "v", "id", F.lit(1.0).alias("pre"), "d")
    every = single.unionByName(pairs).groupBy("qid", "alt", "v", "id").agg(F.sum("pre").alias("pre"), F.min("d").alias("d"))
    ranked = every.withColumn("r", F.row_number().over(Window.partitionBy("qid", "alt", "v").orderBy(F.desc("pre"), "d", "id")))
    return ranked.filter(F.col("r") <= CANDIDATES).select("qid", "alt", "id").distinct()


def word_quality(pairs: DataFrame, known: DataFrame, generic: frozenset[str]) -> DataFrame:
    """Adds quality to (w, last, t, first, joined): how well the token of a place fits the word, from 0 to 1."""
    w, t, last, joined = F.col("w"), F.col("t"), F.col("last"), F.col("joined")
    mine = known.select(F.col("t").alias("w"), F.col("stem").alias("ws"), F.col("loose").alias("wl"), F.col("bones").alias("wk"), F.col("edits").alias("budget"))
    rows = pairs.join(mine, "w").join(known.select("t", F.col("stem").alias("ts"), F.col("loose").alias("tl"), F.col("bones").alias("tk")), "t")
    ws, ts, wk, tk = (F.col(c) for c in ("ws", "ts", "wk", "tk"))
    same_stem = F.arrays_overlap(F.array(w, ws), F.array(t, ts))
    kinds = ts.isin(*generic) | t.isin(*generic) | w.rlike("^[0-9]+$")
    begins = t.startswith(w)
    share = F.char_length(F.when(begins, w).otherwise(ws)) / F.greatest(F.lit(1), F.char_length(F.when(begins, t).otherwise(ts)))
    prefix = (QUALITY["prefix_least"] + (QUALITY["prefix_most"] - QUALITY["prefix_least"]) * share) * F.when((F.char_length(w) == 1) & ~F.col("first"), 0.6).otherwise(1.0)
    equal = F.filter(wk, lambda a: F.array_contains(tk, a))
    long_equal, short_equal = F.exists(equal, lambda a: F.char_length(a) >= 3), (F.size(equal) > 0) & (F.char_length(ws) <= 6) & (F.char_length(ts) <= 6)
    bones = F.when(long_equal, QUALITY["skeleton"]).when(short_equal, QUALITY["skeleton2"]).otherwise(0.0) * F.when(F.char_length(w) <= 3, 0.6).otherwise(1.0)
    begun = F.when(last & F.exists(wk, lambda a: F.exists(tk, lambda b: (a != b) & b.startswith(a))), QUALITY["skeleton_prefix"]).otherwise(0.0)
    settled = (
        F.when(t == w, F.when(joined, QUALITY["join"]).otherwise(QUALITY["word"])).when(same_stem, F.when(joined, QUALITY["join"]).otherwise(QUALITY["stem"])).when(kinds, 0.0)
        .when(~joined & (F.char_length("wl") >= 2) & (F.col("tl") == F.col("wl")), QUALITY["loose"]).when(last & (begins | ts.startswith(ws)), prefix)
    )
    rows = rows.withColumns({"settled": settled, "bones": F.greatest(bones, begun)})
    close = F.exists(wk, lambda a: F.exists(tk, lambda b: (F.char_length(a) >= 4) & (F.char_length(b) >= 4) & (F.abs(F.char_length(a) - F.char_length(b)) <= 1)))
    may = F.col("settled").isNull() & (((F.col("budget") > 0) & ~joined & (F.abs(F.char_length(w) - F.char_length(t)) <= F.col("budget"))) | (close & (F.col("bones") < QUALITY["skeleton_fuzzy"])))
    rows = cut(rows.withColumn("may", F.coalesce(may, F.lit(False))))
    done = rows.filter(~F.col("may")).withColumn("quality", F.coalesce("settled", "bones"))
    left = rows.filter("may").withColumns({"e": S.osa(w, t, 2), "se": S.osa(F.coalesce(F.get(wk, F.lit(0)), F.lit("")), F.coalesce(F.get(tk, F.lit(0)), F.lit("")), 1)})
    fuzzy = F.greatest(F.col("bones"), F.when(close & (F.col("se") <= 1), QUALITY["skeleton_fuzzy"]).otherwise(0.0))
    typo = F.when((F.col("budget") > 0) & ~joined & (F.col("e") <= F.col("budget")), F.when(F.col("e") <= 1, QUALITY["typo1"]).otherwise(QUALITY["typo2"])).otherwise(0.0)
    left = left.withColumn("quality", F.when(fuzzy > 0, fuzzy).otherwise(typo))
    keep = [*pairs.columns, "quality"]
    return done.select(*keep).union(left.select(*keep)).filter("quality > 0")


def text_scores(candidates: DataFrame, lists: DataFrame, tokens: DataFrame, vocab: DataFrame, count: int, generic: frozenset[str], known: DataFrame) -> DataFrame:
    """(qid, alt, v, id, text): the fit of each list of words to each candidate (qid, alt, id).

    Words weigh by rarity; one of three words and more may be missing if it doesn't outweigh the rest; a quarter goes by how much of the place's own name the words account for.
    """
    at = lists.select("qid", "alt", "v", F.size("words").alias("n"), F.posexplode("words").alias("i", "w")).withColumn("last", F.col("i") == F.col("n") - 1)
    at = cut(at)
    own = at.select(F.col("w").alias("t")).distinct().join(known, "t").select(F.col("t").alias("w"), F.explode(F.array_distinct(F.array("t", "stem"))).alias("term"))
    df = own.join(vocab, "term", "left").groupBy("w").agg(F.coalesce(F.max("df"), F.lit(0)).alias("df"))
    weight = df.select("w", F.greatest(F.lit(0.12), F.log(1 + count / (1 + F.col("df"))) / F.log(F.lit(1.0 + count))).alias("weight"))
    mine = cut(candidates.select("id").distinct().join(tokens, "id"))
    met = candidates.join(at.select("qid", "alt", "w", "last").distinct(), ["qid", "alt"]).select("w", "last", "id").distinct()
    pairs = met.join(mine, "id").select("w", "last", "t", "first", "joined").distinct()
    fit = cut(word_quality(pairs, known, generic))
    factor = reduce(lambda rest, k: F.when(F.col("field") == k, FIELDS[k]).otherwise(rest), range(2), F.lit(FIELDS[2]))
    each = candidates.join(at, ["qid", "alt"]).join(mine, "id").join(fit, ["w", "last", "t", "first", "joined"])
    scaled = F.col("quality") * factor
    best = each.groupBy("qid", "alt", "v", "id", "i").agg(F.max(F.when(F.col("first") & (F.col("field") == 0), F.least(F.lit(1.0), scaled + FIRST_WORD)).otherwise(scaled)).alias("q"))
    parts = at.join(weight, "w").select("qid", "alt", "v", "n", "i", "weight")
    sums = parts.groupBy("qid", "alt", "v", "n").agg(F.sum("weight").alias("total"))
    got = best.join(parts, ["qid", "alt", "v", "i"]).groupBy("qid", "alt", "v", "id").agg(F.sum(F.col("q") * F.col("weight")).alias("s"), F.sum("weight").alias("has"), F.count("*").alias("hits"), F.min("q").alias("least"))
    names = mine.filter("field = 0 and not joined")
    plain = F.least(F.lit(1.0), F.col("quality") + F.when(F.col("first"), FIRST_WORD).otherwise(0.0))
    told = candidates.join(at, ["qid", "alt"]).join(names, "id").join(fit, ["w", "last", "t", "first", "joined"]).filter(plain >= 0.7).select("qid", "alt", "v", "id", "name", "t").distinct().groupBy("qid", "alt", "v", "id", "name").agg(F.count("*").alias("told"))
    size = names.groupBy("id", "name").agg(F.count_distinct("t").alias("size"))
    covered = told.join(size, ["id", "name"]).groupBy("qid", "alt", "v", "id").agg(F.max(F.col("told") / F.col("size")).alias("cover"))  # of the name that the words account for best
    rows = got.join(sums, ["qid", "alt", "v"]).join(covered, ["qid", "alt", "v", "id"], "left")
    missing, lost = F.col("n") - F.col("hits"), F.col("total") - F.col("has")
    allowed = (missing == 0) | ((F.col("n") > 2) & (missing == 1) & (lost <= 0.5 * F.col("total")))
    cover = F.coalesce("cover", F.lit(0.0))
    text = (1 - COVERAGE) * F.col("s") / F.col("total") + COVERAGE * cover
    text = F.when((cover >= 0.999) & (missing == 0) & (F.col("least") >= 0.9), F.least(F.lit(1.0), text + EXACT)).otherwise(text)
    return rows.filter(allowed).select("qid", "alt", "v", "id", text.alias("text"))


def category_candidates(rows: DataFrame, places: DataFrame, lexicon: P.Lexicon, least: int = RING_LEAST) -> DataFrame:
    """(qid, alt, id): places of the kind by rings that double until they hold ``least`` or reach the cap."""
    members = F.create_map(*(x for k, v in (dict(lexicon.families) or {"": ()}).items() for x in (F.lit(k), F.array(*map(F.lit, v or ("",))))))
    wide = F.when(F.col("class").isin("destination", "landmark"), RING_CAP_M * 2.5).otherwise(RING_CAP_M)
    asked = rows.filter(F.col("kind").isin("category", "cat_name")).withColumn("class", _class(F.col("scat"), lexicon))
    asked = asked.select("qid", "alt", "alat", "alng", F.greatest(F.lit(RING_M), F.coalesce(F.col("area.radius") * 1.5, F.lit(0.0))).alias("r0"), wide.alias("cap"), F.explode(F.coalesce(F.try_element_at(members, F.col("scat")), F.array("scat"))).alias("scat"))
    hit = asked.join(places.select("id", "scat", "lat", "lng"), "scat").withColumn("d", metres(F.col("alat"), F.col("alng"), F.col("lat"), F.col("lng")))
    ring = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("d"), F.lit(1.0)) / F.col("r0")))).cast("int")
    last = F.ceil(F.log2(F.greatest(F.col("cap") / F.col("r0"), F.lit(1.0)))).cast("int")
    hit = hit.withColumn("ring", ring).filter(F.col("ring") <= last)
    counts = hit.groupBy("qid", "alt", "ring").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("qid", "alt").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = counts.withColumn("before", before).filter(F.col("before") < least).select("qid", "alt", "ring")
    return hit.join(kept, ["qid", "alt", "ring"]).select("qid", "alt", "id").distinct()


def _class(scat: Column, lexicon: P.Lexicon) -> Column:
    known = F.create_map(*(F.lit(x) for p in (dict(lexicon.proximity) or {"": "local"}).items() for x in p))
    return F.coalesce(F.try_element_at(known, F.coalesce(scat, F.lit(""))), F.lit("local"))


def tau(scat: Column, near: Column, lexicon: P.Lexicon) -> Column:
    """How far a kind of place is worth going, in metres; less where the query asks for one near by."""
    of_class = F.create_map(*(F.lit(x) for p in TAU.items() for x in p))
    return of_class[_class(scat, lexicon)] * F.when(near, 0.6).otherwise(1.0)


def brand_family(a: Column, b: Column) -> Column:
    """Whether branches of a chain may be of either kind."""
    together = reduce(lambda x, y: x | y, (a.isin(*f) & b.isin(*f) for f in BRAND_FAMILIES))
    return F.coalesce((a == b) | together, F.lit(False))


def route_metres(route: Column, lat: Column, lng: Column, most: int = 200) -> Column:
    """The least distance to a vertex of the route, to every so manieth of a long one."""
    step = F.greatest(F.lit(1), F.floor(F.size(route) / most).cast("int"))
    some = F.filter(route, lambda v, i: i % step == 0)
    return F.array_min(F.transform(some, lambda v: metres(v["lat"], v["lng"], lat, lng)))


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def scored(found: DataFrame, lexicon: P.Lexicon) -> DataFrame:
    """Adds score to candidates that a reading admits; a row has the reading, the place and its text."""
    c = {n: F.col(n) for n in ("kind", "text", "d", "tau", "scat", "pop", "conf")}
    family = F.create_map(*(x for k, v in (dict(lexicon.families) or {"": ()}).items() for x in (F.lit(k), F.array(*map(F.lit, v or ("",))))))
    of_kind = (F.col("pscat") == c["scat"]) | F.coalesce(F.array_contains(F.try_element_at(family, c["scat"]), F.col("pscat")), F.lit(False))
    branch = F.coalesce(F.col("pbrand") == F.col("p.brand"), F.lit(False))
    soft = branch | ((F.col("pkind") == 0) & (c["text"] >= 0.75) & brand_family(F.col("pscat"), F.col("p.brand_scat")))
    street, asked = F.col("pkind") == 2, F.col("p.street")
    catm = F.when(F.coalesce(of_kind, F.lit(False)), 1.0).when(c["scat"].isNotNull() & branch, 0.8).otherwise(0.0)
    near = lambda half: 1 / (1 + c["d"] / half)
    profile = F.when(c["kind"].isin("category", "cat_name", "brand"), c["kind"]).when(street & asked, "street").when(F.col("pkind") == 1, "area").otherwise("name")
    prox = F.when(profile == "category", F.exp(-c["d"] / c["tau"])).when(profile == "cat_name", near(F.greatest(c["tau"], F.lit(3000.0)))).when(profile == "brand", F.exp(-c["d"] / F.greatest(c["tau"], F.lit(4000.0)))).when(profile == "street", near(2500.0)).otherwise(near(6000.0))
    text = F.when(profile == "category", 1.0).when(profile == "brand", F.when(soft, 1.0).otherwise(c["text"] * 0.6)).otherwise(c["text"])
    kind_part = F.when((profile == "brand") & soft, 1.0).otherwise(catm)
    admitted = (
        F.when(profile == "category", catm >= 1).when(profile == "cat_name", ((c["text"] >= 0.42) | (catm >= 1)) & (c["text"] >= 0.42 * 0.6))
        .when(profile == "brand", soft | ((c["text"] >= 0.85) & (F.col("pkind") == 0))).otherwise(c["text"] >= 0.5)
    )
    area = F.col("area").isNull() | (c["kind"] == "name") | (c["d"] <= F.greatest(F.col("area.radius") * 2.2, F.lit(4000.0)))
    weight = lambda k: reduce(lambda rest, n: F.when(profile == n, WEIGHTS[n][k]).otherwise(rest), WEIGHTS, F.lit(0.0))
    blend = _add([weight(0) * text, weight(1) * prox, weight(2) * F.coalesce(c["pop"], F.lit(0.0)), weight(3) * F.coalesce(c["conf"], F.lit(0.0)), weight(4) * kind_part])
    unasked = F.when((c["kind"] == "name") & street & ~asked, -0.06).otherwise(0.0)
    boosted = F.when(asked & street, 0.12 + F.when(F.col("p.road") & F.col("cat").isin("road", "highway", "axis", "bridge"), 0.06).otherwise(0.0)).otherwise(0.0)
    return found.filter(admitted & area).withColumn("score", blend + unasked + boosted)


RESULT = ["qid", "alt", "id", "pid", "pkind", "cat", "pscat", "plat", "plng", "name", "grp", "pbrand", "pop", "conf", "d_user", "d", "text", "score"]


def collapsed(results: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of each query (qid, front): pieces of a street are the one nearest to what is measured from, with the best score; same names of a kind within 150 m are one."""
    whole = Window.partitionBy("qid", "front", "grp")
    piece = F.row_number().over(whole.orderBy("d", F.desc("score"), "pid"))
    rows = results.withColumns({"piece": F.when(F.col("grp").isNull(), 1).otherwise(piece), "score": F.when(F.col("grp").isNull(), F.col("score")).otherwise(F.max("score").over(whole))}).filter("piece = 1").drop("piece")
    names = [*rows.columns, "rank"]

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "d_user", "pid"], ascending=[False, True, True], kind="stable")
        kept: list[int] = []
        for k, r in enumerate(group.itertuples()):
            same = [group.iloc[j] for j in kept if group.iloc[j]["nk"] == r.nk and (group.iloc[j]["cat"] == r.cat or group.iloc[j]["pscat"] == r.pscat)]
            if not any(_metres(s["plat"], s["plng"], r.plat, r.plng) < SAME_M for s in same):
                kept.append(k)
            if len(kept) == limit:
                break
        out = group.iloc[kept].copy()
        out["rank"] = range(1, len(kept) + 1)
        return out[names]

    return rows.groupBy("qid", "front").applyInPandas(pick, rows.withColumn("rank", F.lit(0)).schema)


def _metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return float(2 * 6_371_000 * np.arcsin(min(1.0, np.sqrt(h))))


def chain_rerank(results: DataFrame, of_query: DataFrame) -> DataFrame:
    """A name that three or more of the twelve best hits carry as one chain ranks its branches as a chain's, the nearest first."""
    top = results.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "d_user", "pid"))).filter("r <= 12 and pbrand is not null and text >= 0.8")
    counts = top.groupBy("qid", "pbrand").agg(F.count("*").alias("n"), F.min("r").alias("r")).filter("n >= 3")
    chain = counts.groupBy(F.col("qid").alias("cq")).agg(F.max_by("pbrand", F.struct("n", -F.col("r"))).alias("chain"))
    q = of_query.filter("kind = 'name'").select(F.col("qid").alias("oq"), F.col("alt").alias("oa"), "tau")
    rows = results.join(chain, F.col("qid") == F.col("cq"), "left").join(q, (F.col("qid") == F.col("oq")) & (F.col("alt") == F.col("oa")), "left")
    w = WEIGHTS["brand"]
    own = (F.col("pbrand") == F.col("chain")) & (F.col("text") >= 0.8) & F.col("oq").isNotNull()
    score = w[0] + w[1] * F.exp(-F.col("d") / F.greatest(F.col("tau"), F.lit(4000.0))) + w[2] * F.coalesce("pop", F.lit(0.0)) + w[3] * F.coalesce("conf", F.lit(0.0)) + w[4]
    return rows.withColumn("score", F.when(F.coalesce(own, F.lit(False)), score).otherwise(F.col("score"))).select(*results.columns)


def entity_pins(rows: DataFrame, results: DataFrame) -> DataFrame:
    """The lexicon's own pin for a named entity where no good hit lies near it."""
    e = F.col("p.entity")
    asked = rows.filter(e.isNotNull() & (F.col("kind") == "name")).select("qid", "alt", "lat", "lng", e.alias("e"))
    good = results.filter("text >= 0.8").select(F.col("qid").alias("gq"), F.col("alt").alias("ga"), "plat", "plng")
    near = metres(F.col("e.lat"), F.col("e.lng"), F.col("plat"), F.col("plng")) <= F.greatest(F.col("e.radius"), F.lit(REFINE_M))
    left = asked.join(good, (F.col("qid") == F.col("gq")) & (F.col("alt") == F.col("ga")) & near, "left_anti")
    d = metres(F.col("lat"), F.col("lng"), F.col("e.lat"), F.col("e.lng"))
    area = F.col("e.kind") == "area"
    score = F.when(area, _add([F.lit(WEIGHTS["area"][0] * 0.92), WEIGHTS["area"][1] / (1 + d / 6000), F.lit(WEIGHTS["area"][2] * 0.6)])).otherwise(_add([F.lit(WEIGHTS["name"][0] * 0.92), WEIGHTS["name"][1] / (1 + d / 6000), F.lit(WEIGHTS["name"][2] * 0.6 + WEIGHTS["name"][3] * 0.9)]))
    none = F.lit(None).cast("string")
    return left.select(
        "qid", "alt", F.lit(0).cast("long").alias("id"), F.concat(F.lit("lex:"), "e.id").alias("pid"), F.when(area, 1).otherwise(0).alias("pkind"), F.when(area, "neighbourhood").otherwise(F.col("e.kind")).alias("cat"), none.alias("pscat"), F.col("e.lat").alias("plat"), F.col("e.lng").alias("plng"),
        F.coalesce("e.ar", "e.en").alias("name"), none.alias("grp"), none.alias("pbrand"), F.lit(0.6).alias("pop"), F.lit(0.9).alias("conf"), d.alias("d_user"), d.alias("d"), F.lit(1.0).alias("text"), score.alias("score"),
    ).select(*RESULT)


def exact_names(rows: DataFrame, places: DataFrame, lexicon: P.Lexicon) -> DataFrame:
    """Places whose whole name is the query's words, for readings of a kind that also name something."""
    toks = F.filter(F.col("p.toks"), lambda t: ~X.is_stop(t) & ~t.isin(*P.NEAR_WORDS, *P.FILLERS, *P.IN_WORDS))
    stems = F.array_sort(F.array_distinct(F.transform(toks, lambda t: F.coalesce(X.stem(t), t))))
    of_kind = F.transform(F.col("p.cat_words"), lambda t: F.coalesce(X.stem(t), t))
    asked = rows.filter("alt = 0 and kind in ('category', 'cat_name')").filter(F.col("p.brand").isNull() & (F.size(toks) >= 2) & F.exists(stems, lambda s: ~s.isin(*lexicon.generic) & ~F.array_contains(of_kind, s)))
    hits = asked.select("qid", "alt", "lat", "lng", F.array_join(stems, " ").alias("whole")).join(cores(places).select("id", "whole").distinct(), "whole").join(_as_places(places), "id")
    d = metres(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))
    w = WEIGHTS["name"]
    near = hits.withColumn("d", d).filter(F.col("d") <= TEXT_M)
    score = w[0] + w[1] / (1 + F.col("d") / 6000) + w[2] * F.coalesce("pop", F.lit(0.0)) + w[3] * F.coalesce("conf", F.lit(0.0))
    return near.withColumns({"d_user": F.col("d"), "text": F.lit(1.0), "score": score}).select(*RESULT)


def _as_places(places: DataFrame) -> DataFrame:
    return places.select("id", "pid", F.col("kind").alias("pkind"), "cat", F.col("scat").alias("pscat"), F.col("lat").alias("plat"), F.col("lng").alias("plng"), F.coalesce("name_ar", "name_en").alias("name"), "grp", F.col("brand").alias("pbrand"), "pop", "conf")


def driving_words(*lists: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), (x.select(F.explode("words").alias("t")) for x in lists))


def search(queries: DataFrame, places: DataFrame, lexicon: P.Lexicon, limit: int = 10) -> DataFrame:
    """The ranked places of each query: qid, rank, pid, name, category, scat, kind (of the reading), distance_m, score, text.

    queries: qid, q, lat, lng, and optionally route (array<struct<lat,lng>>) and dest (struct<lat,lng>).  places: as PLACE.
    """
    for name, kind in (("route", "array<struct<lat:double,lng:double>>"), ("dest", "struct<lat:double,lng:double>")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    tokens = cut(place_tokens(places))
    written = forms(tokens)
    posted = cut(postings(tokens, written))
    vocab = cut(vocabulary(posted))
    count = max(places.count(), 1)
    parsed = queries.select("qid", "q", "lat", "lng", "route", "dest").join(P.parse(queries, lexicon, vocab), "qid")
    if lexicon.entities:
        known = {e.id: e for e in lexicon.entities.values()}
        rows = queries.sparkSession.createDataFrame([(e.id, [n for n in (e.ar, e.en, *e.names) if n], e.lat, e.lng, e.kind) for e in known.values()], "eid string, names array<string>, lat double, lng double, kind string")
        moved = F.broadcast(refine(rows, places).select(F.col("eid"), F.struct("lat", "lng").alias("m")))  # a row for an entity of the lexicon at most
        parsed = parsed.join(moved, F.col("p.entity.id") == F.col("eid"), "left")
        at = F.struct(F.coalesce("m.lat", "p.entity.lat").alias("lat"), F.coalesce("m.lng", "p.entity.lng").alias("lng"))
        entity = F.when(F.col("p.entity").isNotNull(), F.col("p.entity").withField("lat", at["lat"]).withField("lng", at["lng"]))
        area = F.when(F.col("p.area").isNotNull(), F.col("p.area").withField("lat", F.coalesce("m.lat", "p.area.lat")).withField("lng", F.coalesce("m.lng", "p.area.lng")))
        parsed = parsed.withColumn("p", F.col("p").withField("entity", entity).withField("area", area)).drop("eid", "m")
    rows = readings(parsed, places)
    anchor = F.when(F.col("area").isNotNull() & ~F.col("area.road"), F.struct("area.lat", "area.lng")).when((F.col("scope") == "near_destination") & F.col("dest").isNotNull(), F.struct("dest.lat", "dest.lng")).otherwise(F.struct("lat", "lng"))
    rows = cut(rows.withColumns({"alat": anchor["lat"], "alng": anchor["lng"], "tau": tau(F.coalesce("scat", "p.brand_scat"), F.col("p.near"), lexicon)}))
    lists = rows.select("qid", "alt", F.col("alat").alias("lat"), F.col("alng").alias("lng"), F.posexplode(F.concat(F.array("residual"), F.coalesce("p.expansions", F.array()))).alias("v", "words")).filter(F.size("words") > 0)
    with_kind = rows.filter("kind = 'cat_name'").select("qid", "alt", F.col("alat").alias("lat"), F.col("alng").alias("lng"), F.lit(0).alias("v"), F.concat("p.cat_words", "residual").alias("words"))
    known = forms(tokens.select("t").union(driving_words(lists, with_kind)))
    driving = lists.join(with_kind.select("qid", "alt", "v"), ["qid", "alt", "v"], "left_anti").unionByName(with_kind)
    of_brand = rows.filter(F.col("p.brand").isNotNull()).select("qid", "alt", "alat", "alng", F.col("p.brand").alias("brand")).join(places.select("id", "brand", F.col("lat").alias("x"), F.col("lng").alias("y")), "brand").filter(metres(F.col("alat"), F.col("alng"), F.col("x"), F.col("y")) <= BRAND_M).select("qid", "alt", "id")
    candidates = cut(text_candidates(driving, posted, vocab, places, known).union(category_candidates(rows, places, lexicon)).union(of_brand).distinct())
    texts = cut(text_scores(candidates, lists, tokens, vocab, count, lexicon.generic, known))
    text = texts.groupBy("qid", "alt", "id").agg(F.max(F.col("text") * F.when(F.col("v") > 0, 0.96).otherwise(1.0)).alias("text"))
    found = candidates.join(rows, ["qid", "alt"]).join(_as_places(places), "id").join(text, ["qid", "alt", "id"], "left").withColumn("text", F.coalesce("text", F.lit(0.0)))
    to_anchor, to_user = metres(F.col("alat"), F.col("alng"), F.col("plat"), F.col("plng")), metres(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))
    found = found.withColumns({"d": F.coalesce(route_metres(F.col("route"), F.col("plat"), F.col("plng")), to_anchor), "d_user": to_user})
    hits = cut(scored(found, lexicon).select(*RESULT))
    hits = hits.unionByName(entity_pins(rows, hits))
    first = hits.groupBy(F.col("qid").alias("fq")).agg(F.min("alt").alias("fa"))
    hits = hits.join(first, (F.col("qid") == F.col("fq")) & (F.col("alt") == F.col("fa"))).drop("fq", "fa")
    hits = cut(chain_rerank(cut(hits), rows))
    exact = cut(collapsed(exact_names(rows, places, lexicon).withColumns({"front": F.lit(0), "nk": X.normalize(F.col("name"))}), 3))
    hits = hits.join(exact.select(F.col("qid").alias("eq"), F.col("pid").alias("ep")), (F.col("qid") == F.col("eq")) & (F.col("pid") == F.col("ep")), "left_anti")
    rest = collapsed(hits.withColumns({"front": F.lit(1), "nk": X.normalize(F.col("name"))}), limit)
    every = exact.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("front", "rank"))).filter(F.col("rank") <= limit)
    return every.join(rows.select("qid", "alt", "kind"), ["qid", "alt"]).select("qid", "rank", "pid", "name", F.col("cat").alias("category"), F.col("pscat").alias("scat"), "kind", F.col("d_user").alias("distance_m"), "score", "text")
