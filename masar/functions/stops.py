"""Stops along a trip: what a place is called and what kind it is, and what a request to add, remove or switch does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from masar.functions.language import folded
from masar.functions.text import let

# Chains with the kind of stop they are, phrases that only name a kind, and the types of places that words ask for.
BRANDS = (
    ("fuel", ("master", "ماستر")), ("fuel", ("chillout", "chill out", "تشيل اوت", "شيل اوت")), ("fuel", ("on the run", "اون ذا رن", "اون ذاران")), ("fuel", ("circle k", "سيركل ك")), ("fuel", ("wataniya", "watanya", "الوطنيه", "وطنيه")), ("fuel", ("misr petroleum", "مصر للبترول")), ("fuel", ("totalenergies", "total", "توتال")), ("fuel", ("mobil", "موبيل")), ("fuel", ("emarat misr", "امارات مصر")),
    ("cafe", ("cilantro", "سيلانترو")), ("cafe", ("costa", "كوستا")), ("cafe", ("starbucks", "ستاربكس")), ("cafe", ("dunkin", "دانكن")), ("cafe", ("beano", "بينوس")), ("restaurant", ("mcdonald", "ماكدونالدز")), ("restaurant", ("kfc", "كنتاكي")), ("restaurant", ("mo'men", "momen", "مؤمن")), ("restaurant", ("cook door", "كوك دور")), ("restaurant", ("buffalo burger", "بافلو برجر")),
    ("pharmacy", ("el ezaby", "ezaby", "العزبي", "عزبي")), ("pharmacy", ("seif", "صيف")), ("pharmacy", ("19011",)),
)
GENERIC = {
    "fuel": ("gas station", "petrol station", "fuel station", "gas", "fuel", "petrol", "بنزينه", "بنزين", "محطه بنزين", "محطه وقود", "محطه"), "pharmacy": ("pharmacy", "drugstore", "صيدليه", "اجزخانه"), "atm": ("atm", "cash machine", "صراف", "صراف الي"), "restaurant": ("restaurant", "مطعم"),
    "cafe": ("cafe", "coffee shop", "coffee", "كافيه", "قهوه"), "parking": ("parking", "car park", "موقف", "باركينج", "جراج"),
}
TYPES = {
    "gas_station": ("gas station", "petrol station", "gas", "fuel", "بنزينه", "محطه بنزين", "محطه وقود", "بنزين"), "restaurant": ("restaurant", "restaurants", "مطعم", "مطاعم", "food", "اكل"), "cafe": ("cafe", "coffee", "coffee shop", "كافيه", "كافيهات", "قهوه", "café"), "meal_takeaway": ("fast food", "takeaway", "تيك اواي"), "bar": ("bar", "بار"), "bakery": ("bakery", "مخبز", "فرن"),
    "ice_cream_shop": ("ice cream", "ايس كريم", "جيلاتي"), "mosque": ("mosque", "جامع", "مسجد", "جوامع", "مساجد"), "church": ("church", "كنيسه"), "shopping_mall": ("mall", "مول", "مولات", "shopping mall", "سنتر"), "supermarket": ("supermarket", "سوبر ماركت", "سوبرماركت", "hypermarket", "هايبر"), "grocery_store": ("grocery", "بقاله"),
    "convenience_store": ("convenience store", "بقاله صغيره", "supermarket small"), "electronics_store": ("electronics", "الكترونيات", "phone shop", "محل موبايلات"), "clothing_store": ("clothes", "ملابس"), "pharmacy": ("pharmacy", "صيدليه", "اجزخانه", "drugstore"), "hospital": ("hospital", "مستشفي"), "doctor": ("clinic", "عياده", "دكتور"), "atm": ("atm", "cash machine", "صراف", "صراف الي", "ماكينه صراف"), "bank": ("bank", "بنك"),
    "parking": ("parking", "car park", "موقف", "باركينج", "جراج"), "car_wash": ("car wash", "مغسله", "غسيل سيارات"), "car_repair": ("car repair", "ميكانيكي", "ورشه"), "park": ("park", "حديقه", "جنينه"), "movie_theater": ("cinema", "سينما", "movie theater"), "gym": ("gym", "جيم", "نادي"), "video_arcade": ("arcade", "playstation", "بلايستيشن", "بلاي ستيشن", "بلاي"), "bowling_alley": ("bowling", "بولينج"),
    "amusement_center": ("amusement", "ملاهي", "playground"), "zoo": ("zoo", "حديقه حيوان"), "museum": ("museum", "متحف"), "hotel": ("hotel", "فندق"), "train_station": ("train station", "محطه قطر"), "bus_station": ("bus station", "موقف اتوبيس"),
}
TYPE_OF_KIND = {"fuel": "gas_station", "cafe": "cafe", "restaurant": "restaurant", "pharmacy": "pharmacy", "atm": "atm", "parking": "parking"}
OPEN_ENDED = ("hangout", "hang out", "نخرج", "نقعد", "قعده", "مكان حلو", "somewhere", "place to", "fun", "entertainment", "ترفيه", "تسليه")
LEADS, MORE_LEADS = ("the", "a", "an", "nearest", "closest", "اقرب"), ("best", "good", "some", "any", "احسن", "افضل", "اي")
LITERAL = ("stop", "a stop", "the stop", "stops", "new stop", "a new stop", "وقفه", "الوقفه", "وقفه جديده", "محطه", "استوب", "ستوب", "وقوف")
ROAD_WORDS = ("road", "street", "way", "highway", "rd", "st", "the", "el", "al", "one", "طريق", "شارع", "ال")
MOST_MINUTES, MOST_KM, SMALL_MINUTES = 120, 80, 8


def norm(text: Column) -> Column:
    """Lower case, Arabic letters unified, white space squeezed; null is empty."""
    return F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _first(tests: list[tuple[Column, str]]) -> Column:
    return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def _mentions(n: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (n.contains(w) for w in words))


def brand_kind(text: Column) -> Column:
    """The kind of stop of the first known chain that a text mentions; else null."""
    return let(norm(text), _brand_of)


def _brand_of(n: Column) -> Column:
    return _first([(_mentions(n, names), kind) for kind, names in BRANDS])


def _bare(n: Column, leads: tuple[str, ...]) -> Column:
    return F.regexp_replace(n, f"^(?:(?:{'|'.join(leads)}) )+", "")


def generic_kind(text: Column) -> Column:
    """The kind that a phrase names and nothing else ("the nearest gas station"); null for a proper name."""
    return let(_bare(norm(text), LEADS), lambda n: _first([(n.isin(*words), kind) for kind, words in GENERIC.items()]))


def place_type(text: Column) -> Column:
    """The type of place to look for: a chain's, that of the phrase without its lead, or of one of its words; null for open-ended wishes and the rest."""
    whole = lambda t: _first([(t.isin(*words), name) for name, words in TYPES.items()])
    single = [(tuple(w for w in every if " " not in w), name) for name, every in TYPES.items()]
    a_word = lambda ws: _first([(F.arrays_overlap(ws, F.array(*map(F.lit, some))), name) for some, name in single if some])
    of_kind = lambda kind: reduce(lambda rest, k: F.when(kind == k, TYPE_OF_KIND[k]).otherwise(rest), TYPE_OF_KIND, F.lit(None).cast("string"))
    bare = lambda n: let(_bare(n, (*LEADS, *MORE_LEADS)), lambda b: F.coalesce(whole(b), let(F.split(b, " "), a_word)))
    typed = lambda n: let(_brand_of(n), lambda kind: F.when(_mentions(n, OPEN_ENDED), None).when(kind.isNotNull(), of_kind(kind)).otherwise(F.coalesce(whole(n), bare(n))))
    return let(norm(text), typed)


def name_match(asked: Column, found: Column) -> Column:
    """strong where the found name holds the asked one or a name of its chain, or half of its words; else weak."""

    def graded(q: Column, n: Column) -> Column:
        chain = reduce(lambda rest, b: F.when(_mentions(q, b[1]), _mentions(n, b[1])).otherwise(rest), reversed(BRANDS), F.lit(False))
        words = F.array_distinct(F.split(q, " "))
        return F.when((q == "") | n.contains(q) | chain | (F.size(F.array_intersect(words, F.split(n, " "))) >= 0.5 * F.size(words)), "strong").otherwise("weak")

    return let(norm(asked), lambda q: let(norm(found), lambda n: graded(q, n)))


def added_minutes(via_seconds: Column, base_seconds: Column) -> Column:
    """What a stop adds to a trip; null where either duration is unknown."""
    return F.greatest(F.lit(0), F.bround((via_seconds - base_seconds) / 60).cast("int")) * F.when(via_seconds.isNotNull() & base_seconds.isNotNull(), 1)


def stop_decision(place_name: Column, asked: Column, found_name: Column, minutes: Column, km: Column) -> Column:
    """What a request for a stop leads to: ask (no place or kind), none, too_far, auto (clear, known and near) or confirm."""
    literal = norm(place_name).isin(*LITERAL) | norm(asked).isin(*LITERAL) | ((norm(place_name) == "") & (norm(asked) == ""))
    kind = F.struct(generic_kind(place_name).isNotNull().alias("generic"), (norm(place_name) != "").alias("named"))
    proper = let(kind, lambda k: k["named"] & ~k["generic"])
    clear = let(proper, lambda p: F.when(p, True).otherwise(place_type(F.coalesce(F.nullif(place_name, F.lit("")), asked)).isNotNull()))
    strong = let(proper, lambda p: F.when(p, name_match(place_name, found_name) == "strong").otherwise(True))
    far = F.coalesce(minutes > MOST_MINUTES, F.lit(False)) | F.coalesce(km > MOST_KM, F.lit(False))
    return F.when(literal, "ask").when(found_name.isNull(), "none").when(far, "too_far").when(strong & clear & F.coalesce(minutes <= SMALL_MINUTES, F.lit(False)), "auto").otherwise("confirm")


def removed_stop(stops: Column, target: Column, every: Column) -> Column:
    """struct<done, name>: which of the stops a request removes (null name: all); not done where none, several or another is meant."""
    t = norm(target)
    hits = F.filter(stops, lambda s: norm(s).contains(t) | t.contains(norm(s)))
    only = F.when(F.size(stops) == 1, F.get(stops, F.lit(0)))
    name = F.when(t == "", only).when(F.size(hits) == 1, F.get(hits, F.lit(0))).when(F.size(hits) == 0, only)
    there = F.coalesce(F.size(stops) > 0, F.lit(False))
    return F.struct((there & (every | name.isNotNull())).alias("done"), F.when(there & ~every, name).alias("name"))


def matching_alternative(road: Column, alternatives: Column) -> Column:
    """The index of the one alternative (array<struct<index, via, delta>>) whose roads a name's words stand in; null for none or several."""
    words = F.filter(F.split(norm(road), " "), lambda w: (w != "") & ~w.isin(*ROAD_WORDS))
    hits = F.filter(alternatives, lambda a: F.exists(words, lambda w: norm(a["via"]).contains(w)))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["index"])


def fastest_alternative(alternatives: Column) -> Column:
    """The index of the alternative that saves most; null where none saves anything."""
    best = F.array_min(F.transform(F.filter(alternatives, lambda a: a["delta"].isNotNull()), lambda a: F.struct(a["delta"].alias("delta"), a["index"].alias("index"))))
    return F.when(best["delta"] < 0, best["index"])


def notification(kind: Column, level: Column, delay: Column, before: Column, lead: Column, early: Column, dest: Column) -> Column:
    """struct<title, body> of an alert: improvement, escalation, or a new one by its level."""
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    spot = F.coalesce(F.when(lead >= 3, said(" — the slow stretch hits about ", F.floor(lead).cast("int"), " min into your drive")), F.lit(""))
    was = F.coalesce(F.when(before > 0, said(" (was +", before, ")")), F.lit(""))
    up = F.coalesce(F.when(before > 0, said(", up from +", before)), F.lit(""))
    clear = (delay < 5) | level.isin("FREE", "ADVISORY")
    text = lambda title, body: F.struct(title.alias("title"), body.alias("body"))
    return (
        F.when((kind == "improvement") & clear, text(said("Road's clearing up for ", dest, " ✨"), F.lit("That earlier traffic has melted away. You're good to leave right on schedule — enjoy the drive.")))
        .when(kind == "improvement", text(said("Good news — traffic to ", dest, " is easing"), said("It's down to about ", delay, " extra minutes now", was, ". Your planned time should work again.")))
        .when(kind == "escalation", text(said("Traffic to ", dest, " just got heavier"), said("The slowdown grew since we last checked — now about ", delay, " extra minutes", up, ". If you can head out ", early, " min early, now's the moment.")))
        .when(level == "CRITICAL", text(said("Heavy traffic on the way to ", dest, " 🚦"), said("It's rough out there — about ", delay, " extra minutes on your route", spot, ". Leave ", early, " min early and you'll still make it comfortably.")))
        .when(level == "SERIOUS", text(said("Traffic is building toward ", dest), said("Your route is running about ", delay, " minutes slower than usual", spot, ". A ", early, "-minute head start keeps you on time.")))
        .otherwise(text(said("Slight slowdown on the ", dest, " route"), said("A bit of traffic", spot, " — roughly ", delay, " extra minutes. Nothing major, but leave a few minutes early if you're cutting it close.")))
    )
