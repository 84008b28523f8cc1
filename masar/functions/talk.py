"""What is said and heard: Egyptian wording, phantom transcripts, the jury of transcripts, guidance lines, names to leave out, weather, streamed replies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masar.functions import language as L
from masar.functions import speech as Z
from masar.functions import text as X

# Formal words and what is said for them, imperatives that need a vowel, and Latin names as they are said.
FORMAL = {
    "حركة المرور": "الزحمة", "لا يوجد": "مفيش", "لا توجد": "مفيش", "الازدحام": "الزحمة", "ازدحام": "زحمة", "مزدحم": "زحمة", "مزدحمة": "زحمة", "الوجهة": "المكان اللي رايحه", "وجهتك": "المكان اللي رايحه", "ماذا": "ايه", "لماذا": "ليه", "متى": "امتى", "أين": "فين", "كيف": "ازاي",
    "الآن": "دلوقتي", "حاليًا": "دلوقتي", "حالياً": "دلوقتي", "حاليا": "دلوقتي", "جدًا": "أوي", "جداً": "أوي", "قليلًا": "شوية", "قليلاً": "شوية", "أيضًا": "كمان", "أيضاً": "كمان", "أيضا": "كمان", "كذلك": "كمان", "ولكن": "بس", "لكن": "بس", "سيارة": "عربية", "السيارة": "العربية",
    "سيارتك": "عربيتك", "يوجد": "فيه", "توجد": "فيه", "هناك": "فيه", "ليس": "مش", "ليست": "مش", "نعم": "ايوه", "أرغب": "عايز", "تريد": "عايز", "أريد": "عايز", "دقائق": "دقايق", "الدقائق": "الدقايق", "ثوان": "ثواني", "ثوانٍ": "ثواني", "كيلومترات": "كيلو", "كيلومتر": "كيلو", "أمتار": "متر",
    "اليسار": "الشمال", "يسار": "شمال", "يسارًا": "شمال", "يساراً": "شمال", "يمينًا": "يمين", "يميناً": "يمين", "بالتأكيد": "أكيد", "بالطبع": "أكيد", "رائع": "حلو", "ممتاز": "تمام", "للأسف": "معلش", "عذرًا": "معلش", "عذراً": "معلش", "آسف": "معلش", "أعتذر": "معلش", "الرجاء": "لو سمحت", "من فضلك": "لو سمحت", "رجاءً": "لو سمحت",
    "مئتين": "ميتين", "مائتين": "ميتين", "مائة": "مية", "مئة": "مية", "ثلاثة": "تلاتة", "ثلاث": "تلات", "ثلاثين": "تلاتين", "ثمانية": "تمانية", "ثماني": "تماني", "ثمانين": "تمانين", "عبر": "عن طريق", "كاميرا": "رادار", "كاميرات": "رادارات", "الكاميرا": "الرادار", "الكاميرات": "الرادارات",
}
VOWELLED = {"خد": "خُد", "وخد": "وخُد"}
NAMES = {
    "salah salem": "صلاح سالم", "ring road": "الدائري", "mehwar": "المحور", "autostrad": "الأوتوستراد", "6th of october bridge": "كوبري أكتوبر", "6th october bridge": "كوبري أكتوبر", "october bridge": "كوبري أكتوبر", "26th of july corridor": "محور 26 يوليو", "26 july corridor": "محور 26 يوليو", "tahrir square": "ميدان التحرير",
    "nasr city": "مدينة نصر", "heliopolis": "مصر الجديدة", "maadi": "المعادي", "zamalek": "الزمالك", "mohandessin": "المهندسين", "mohandeseen": "المهندسين", "mohandiseen": "المهندسين", "dokki": "الدقي", "giza": "الجيزة", "new cairo": "التجمع", "sheikh zayed": "الشيخ زايد", "cairo airport": "مطار القاهرة", "corniche": "الكورنيش",
    "downtown": "وسط البلد", "haram": "الهرم", "pyramids road": "شارع الهرم", "abbasiya": "العباسية", "ramses": "رمسيس", "shubra": "شبرا", "madinaty": "مدينتي", "rehab": "الرحاب", "obour": "العبور", "mokattam": "المقطم", "muqattam": "المقطم", "nozha": "النزهة", "salam road": "طريق السلام",
    "cairo alexandria desert road": "طريق مصر إسكندرية الصحراوي", "suez road": "طريق السويس", "ismailia road": "طريق الإسماعيلية",
}
KEPT_NUMBER = "19011"
# What silence is heard as, interjections of no language, and the words of weather codes.
PHANTOMS = r"(?i)(thanks? (you )?for watching|please subscribe|like and subscribe|subtitles? by|amara\.org|اشتركوا في القناة|لا تنسوا الاشتراك|ترجمة نانسي|نانسي قنقر|شكرا للمشاهدة|شكرا على المشاهدة|شكرا لكم على المشاهدة|\[موسيقى\]|\(موسيقى\)|\[music\]|\(music\))"
SHORT_PHANTOMS = ("you", "thank you", "thanks", "bye", "okay", "ok", "so", "the", "uh", "um", "hmm", "شكرا", "شكرًا", "مع السلامة", "السلام عليكم", "ممم", "اه")
INTERJECTIONS = ("ah", "aah", "uh", "um", "hmm", "mm", "oh", "eh", "ok", "okay", "okey", "ه", "اه", "آه", "اها", "اوكي", "أوكي", "اوك", "ممم", "امم", "هه")
SKY = {
    0: "clear", 1: "mostly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "freezing fog", 51: "light drizzle", 53: "drizzle", 55: "heavy drizzle", 56: "freezing drizzle", 57: "freezing drizzle", 61: "light rain", 63: "rain", 65: "heavy rain", 66: "freezing rain", 67: "freezing rain",
    71: "light snow", 73: "snow", 75: "heavy snow", 77: "snow grains", 80: "rain showers", 81: "heavy rain showers", 82: "violent rain showers", 85: "snow showers", 86: "snow showers", 95: "thunderstorm", 96: "thunderstorm with hail", 99: "thunderstorm with hail",
}
# How a line of directions begins, and its words in lower case.
GUIDANCE = r"(?i)^(?:Heads up — )?(?:in [\d.,]+ (?:meters?|kilometers?|km|miles?|feet), )?(?:turn|continue|keep|take|at the roundabout|make a|merge|exit|enter|go|start|drive|head|bear|stay|you have arrived|you will arrive|you are arriving|your destination|arrive|proceed|the destination|then|slight|sharp|use the|ramp|u-turn)\b"
DIRECTIONS = "a after ahead al and arrive arrived arriving at be bear before both but by continue destination drive east el exit exits ferry first fifth for fork fourth go have head heads immediately in into is it keep kilometer kilometers km lane lanes left make market meter meters mile miles feet merge north northeast northwest of on onto or permitted proceed ramp right road roundabout rotary second seventh sharp side sixth slight south southeast southwest start stay straight take tenth the then third to toward towards turn u up use uturn via west will you your ninth eighth end street if traffic circle slightly ibn bin desert service".split()
RATED = ("restaurant", "cafe", "coffee", "bar", "bakery", "meal_", "ice_cream", "food", "shopping", "store", "market", "mall", "movie", "video_arcade", "bowling", "amusement", "karaoke", "night_club", "casino", "zoo", "aquarium", "museum", "tourist_attraction", "hotel", "lodging", "gym", "fitness", "spa", "beauty", "hair")
PLACEHOLDER = {"ar": "المكان", "en": "the place"}
PROCLITICS = "(?:و|ف)?(?:ب|ل|ك|ع|عال)?"
WEATHER = "current struct<weather_code:int,temperature_2m:double,apparent_temperature:double,wind_speed_10m:double,wind_gusts_10m:double,visibility:double>, hourly struct<weather_code:array<int>,precipitation_probability:array<int>>"
CHUNK = "choices array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>"


def egyptianized(text: Column) -> Column:
    """Numbers, clocks, decimals and percentages of an Arabic line in words; names that hold digits stay."""
    t = F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")
    for unit, two, one in (("كيلو(?:متر)?", "كيلوين", "كيلو"), ("دقيق[ةه]", "دقيقتين", "دقيقة"), ("ساع[ةه]", "ساعتين", "ساعة")):
        t = F.regexp_replace(F.regexp_replace(t, rf"(?<![\w.:])2\s+{unit}(?![ء-ي])", two), rf"(?<![\w.:])1\s+{unit}(?![ء-ي])", one)
    return X.let(t, _numbers_said)


def _numbers_said(t: Column) -> Column:
    pieces = F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z0-9]*|\d+[A-Za-z][A-Za-z0-9]*|\d{1,2}:\d{2}(?![\d:])|\d+\s*[%٪]|\d+[.,٫]\d(?![\d.])|[\d:.]*\d|[^A-Za-z0-9]+)"), F.lit(1))

    def worded(parts: Column, part: Column, at: Column) -> Column:
        number = lambda s: F.try_to_number(s, F.lit("999999")).cast("long")
        hour, minute = F.split(part, ":")[0].cast("int"), F.try_element_at(F.split(part, ":"), F.lit(2)).cast("int")
        whole, tenth = number(F.split(part, "[.,٫]")[0]), F.try_element_at(F.split(part, "[.,٫]"), F.lit(2)).cast("int")
        decimal = F.when(tenth == 0, Z.spoken_number(whole)).when((tenth == 5) & (whole == 0), "نص").when(tenth == 5, F.concat(Z.spoken_number(whole), F.lit(" ونص"))).otherwise(F.concat(Z.spoken_number(whole), F.lit(" فاصل "), Z.spoken_number(tenth)))
        after = F.concat(F.coalesce(F.get(parts, at + 1), F.lit("")), F.coalesce(F.get(parts, at + 2), F.lit("")))
        clock = F.when((hour < 24) & (minute < 60), Z.spoken_clock(hour * 60 + minute))
        plain = F.when((part != KEPT_NUMBER) & ~after.rlike(r"^\s*[A-Za-z]"), Z.spoken_number(number(part), after.rlike(r"^\s*[؀-ۿ]")))
        said = (
            F.when(part.rlike(r"^\d{1,2}:\d{2}$"), clock).when(part.rlike("[%٪]$"), F.concat(Z.spoken_number(number(F.regexp_replace(part, r"\s*[%٪]$", ""))), F.lit(" في المية")))
            .when(part.rlike(r"^\d+[.,٫]\d$"), decimal).when(part.rlike(r"^\d{1,6}$"), plain)
        )
        return F.coalesce(said, part)

    words = X.let(pieces, lambda parts: F.array_join(F.transform(parts, lambda part, at: worded(parts, part, at)), ""))
    return F.when(t == "", t).otherwise(words)


def _whole(words: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(words.items(), key=lambda p: (-len(p[0]), p[0]))


def _each_in_turn(text: Column, rules: list[tuple[str, str, str]], seen: Callable[[Column], Column]) -> Column:
    """The text after each rule (a word, its pattern, what is said) in turn; only where the word stands in the text by then is its pattern tried, as few do in a line."""
    table = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(rule, ("word", "pattern", "said"), strict=True))) for rule in rules))
    return F.aggregate(table, text, lambda now, r: F.when(F.contains(seen(now), r["word"]), F.regexp_replace(now, r["pattern"], r["said"])).otherwise(now))


def masri(text: Column) -> Column:
    """Formal words, names and numbers of an Arabic line as they are said in Cairo."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    t = F.translate(text, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))
    t = F.regexp_replace(t, r"(?<![؀-ۿ])سوف\s+(?=[يتنأا][؀-ۿ])", "ه")
    formal = [(w, f"(?<![؀-ۿ])([وف]?){w}(?![؀-ۿ])", f"$1{said}") for w, said in _whole(FORMAL)]
    vowelled = [(w, f"(?<![؀-ۿ]){w}(?![؀-ۿ])", said) for w, said in _whole(VOWELLED)]
    names = [(w, rf"(?i)(?<![A-Za-z])(?:the\s+)?{w}(?![A-Za-z])", said) for w, said in _whole(NAMES)]
    t = _each_in_turn(t, formal + vowelled, lambda now: now)
    t = X.let(t, lambda now: F.when(now.rlike("[A-Za-z]"), _each_in_turn(now, names, F.lower)).otherwise(now))
    return egyptianized(t)


def heard(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\s.,!?؟،…\"'«»:;\\-]+", " "))


def is_phantom(text: Column, confidence: Column) -> Column:
    """Nothing, what subtitles end with, a courtesy that was hardly heard, or one token three times and more."""
    t = heard(text)
    words = F.split(t, " ")
    loop = (F.size(words) >= 3) & (F.size(F.array_distinct(words)) == 1)
    return (t == "") | F.coalesce(text, F.lit("")).rlike(PHANTOMS) | (t.isin(*SHORT_PHANTOMS) & F.coalesce(confidence < 0.5, F.lit(False))) | loop


def is_neutral(text: Column) -> Column:
    """Whether all that is said is interjections."""
    t = heard(text)
    return (t != "") & F.forall(F.split(t, " "), lambda w: w.isin(*INTERJECTIONS))


def script(text: Column, share: float = 0.7) -> Column:
    """The script of seven letters in ten: ar, en or null."""
    ar, la = L.letters(F.coalesce(text, F.lit("")))
    return F.when(ar + la == 0, None).when(ar >= share * (ar + la), "ar").when(la >= share * (ar + la), "en")


#: A witness: its words, how sure it is, and whether it failed.
WITNESS = "struct<text:string,confidence:double,error:string>"


def with_jury(turns: DataFrame, ar: str, en: str, auto: str, before: str, out: str) -> DataFrame:
    """Adds struct<lang, witness, text, ar_votes, en_votes>: the language that three transcripts of one clip point to, and the words to take.

    ``ar`` and ``en`` were told the language, ``auto`` was not.  A null witness didn't answer.  lang is null where none heard anything.
    """
    e = "_jury"

    def read(w: str) -> Column:
        c = F.col(w)
        text = F.when(c.isNotNull() & c["error"].isNull() & ~is_phantom(c["text"], c["confidence"]), c["text"])
        ar_n, la_n = L.letters(F.coalesce(text, F.lit("")))
        return F.struct(
            text.alias("text"), c["confidence"].alias("sure"), script(text).alias("script"), ar_n.alias("ar"), la_n.alias("la"), Z.is_arabizi(text).alias("arabizi"), L.mostly_transliterated(L.arabic_evidence(F.coalesce(text, F.lit("")))).alias("translit"),
            L.english_evidence(F.coalesce(text, F.lit(""))).alias("english"), is_neutral(text).alias("neutral"), F.size(F.split(F.trim(text), r"\s+")).alias("words"),
        )

    t = turns.withColumn(e, F.struct(read(ar).alias("a"), read(en).alias("e"), read(auto).alias("u")))
    a, n, u = (F.col(f"{e}.{k}") for k in "aeu")
    ok = {k: w["text"].isNotNull() for k, w in zip("aeu", (a, n, u), strict=True)}
    few = F.coalesce((n["english"]["considered"] >= 3) & (n["english"]["real"] < 0.4 * n["english"]["considered"]), F.lit(False))
    auto_side = F.when((u["script"] == "en") & u["arabizi"], "ar").when((u["script"] == "ar") & u["translit"], "en").otherwise(u["script"])
    auto_weight = F.when(F.coalesce(u["sure"], F.lit(1.0)) >= 0.5, 2.0).otherwise(1.0)
    gap = a["sure"] - n["sure"]
    sure_weight = F.when(ok["a"] & ok["e"] & (F.abs(gap) >= 0.04), 1.0 + F.when(F.abs(gap) >= 0.15, 1.0).otherwise(0.0) + F.when(F.abs(gap) >= 0.3, 1.0).otherwise(0.0)).otherwise(0.0)
    vote = lambda *parts: reduce(lambda x, y: x + y, (F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in parts))
    heard_auto = ok["u"] & ~u["neutral"]
    ar_votes = vote((ok["e"] & (n["script"] == "ar") & (n["ar"] >= 3), 3.0), (ok["e"] & (n["script"] == "en") & n["arabizi"], 1.5), (ok["e"] & (n["script"] == "en") & ~n["arabizi"] & few, 1.0), (heard_auto & (auto_side == "ar"), auto_weight), (gap > 0, sure_weight), (ok["a"] & ~ok["e"], 0.5))
    en_votes = vote((ok["a"] & (a["script"] == "en") & (a["la"] >= 3), 3.0), (ok["a"] & (a["script"] == "ar") & a["translit"], 1.5), (heard_auto & (auto_side == "en"), auto_weight), (gap < 0, sure_weight), (ok["e"] & ~ok["a"], 0.5))
    t = t.withColumns({f"{e}_ar": ar_votes, f"{e}_en": en_votes})
    prev = F.when(F.col(before).isin("ar", "en"), F.col(before))
    x, y = F.col(f"{e}_ar"), F.col(f"{e}_en")
    longest = F.greatest(*(F.when(ok[k], w["words"]).otherwise(0) for k, w in zip("aeu", (a, n, u), strict=True)))
    margin = F.when((longest <= 2) & prev.isNotNull(), 2.5).otherwise(0.5)
    lead = F.when(x > y, "ar").otherwise("en")
    lang = F.when((F.abs(x - y) >= margin) | F.coalesce((F.abs(x - y) >= 0.5) & (lead == prev), F.lit(False)), lead).otherwise(F.coalesce(prev, F.when(ok["u"], u["script"]), F.when(ok["a"], "ar").otherwise("en")))
    lang = F.when(ok["a"] | ok["e"] | ok["u"], lang)
    t = t.withColumn(f"{e}_lang", lang)
    spoken = F.col(f"{e}_lang")
    writes = lambda w, k: ok[k] & F.coalesce(w["script"] == spoken, F.lit(True))
    pick = lambda test: F.coalesce(F.when((spoken == "ar") & test(a, "a"), "ar"), F.when((spoken == "en") & test(n, "e"), "en"), F.when(test(u, "u"), "auto"), F.when((spoken == "ar") & test(n, "e"), "en"), F.when((spoken == "en") & test(a, "a"), "ar"))
    witness = F.coalesce(pick(writes), pick(lambda w, k: ok[k]))
    words = F.when(witness == "ar", a["text"]).when(witness == "en", n["text"]).when(witness == "auto", u["text"])
    return t.withColumn(out, F.struct(spoken.alias("lang"), witness.alias("witness"), words.alias("text"), x.alias("ar_votes"), y.alias("en_votes"))).drop(e, f"{e}_ar", f"{e}_en", f"{e}_lang")


def is_guidance(text: Column, names: int = 20, run: int = 8, foreign: int = 60) -> Column:
    """Whether a line is directions: it begins like one, its lower-case words are theirs, and its names are few and short."""
    t = F.trim(text)
    token = r"(\d+(?:st|nd|rd|th)?|[A-Za-z]+(?:'[A-Za-z]+)*)"
    words = F.filter(F.regexp_extract_all(t, F.lit(token), F.lit(1)), lambda w: ~w.rlike("^[0-9]"))
    small = F.filter(words, lambda w: ~w.rlike("^[A-Z]"))
    letters_of = lambda clause: F.array_join(F.transform(F.filter(F.regexp_extract_all(clause, F.lit(token), F.lit(1)), lambda w: ~w.rlike("^[0-9]")), lambda w: F.when(w.rlike("^[A-Z]"), "N").otherwise("w")), "")
    long_run = F.exists(F.split(t, "[,.;:!?—]"), lambda c: letters_of(c).contains("N" * (run + 1)))
    return t.rlike(GUIDANCE) & (F.regexp_count(t, F.lit(r"[\p{L}&&[^A-Za-z]]")) <= foreign) & (F.size(words) - F.size(small) <= names) & F.forall(small, lambda w: w.isin(*DIRECTIONS)) & ~long_run


def rating_relevant(kind: Column) -> Column:
    """Whether stars help to choose among places of a kind; of an unknown one they do."""
    t = F.lower(kind)
    return F.coalesce(kind == "", F.lit(True)) | t.rlike(f"^({'|'.join(RATED)})|{'|'.join(r.rstrip('_') for r in RATED)}") | kind.isNull()


def scrubbed(text: Column, names: Column, lang: Column) -> Column:
    """The text with whole names, and the part before a dash, comma or bracket, replaced by a placeholder, longest first.

    An Arabic name may follow a proclitic; alef, final ta marbuta and final ya are matched in all their forms. Names of under three characters stay.
    """
    leads = F.transform(names, lambda n: F.trim(F.split(n, r"\s+[-|–—]\s+|\s*[,(]\s*")[0]))
    every = F.filter(F.array_distinct(F.concat(names, leads)), lambda n: F.char_length(F.trim(n)) >= 3)
    by_length = F.array_sort(every, lambda x, y: F.char_length(y) - F.char_length(x))

    def pattern(n: Column) -> Column:
        quoted = F.regexp_replace(F.trim(n), r"([\\.^$|()\[\]{}*+?-])", r"\\$1")
        wide = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, "[أإآا]", "[أإآا]"), r"[ةه](?!\p{L})", "[ةه]"), r"[ىي](?!\p{L})", "[ىي]")
        return F.when(n.rlike("^ال."), F.concat(F.lit("(?:"), wide, F.lit("|(?:و|ف)?لل"), F.regexp_replace(wide, r"^\[أإآا\]ل", ""), F.lit(")"))).otherwise(wide)

    each = F.array_join(F.transform(by_length, pattern), "|")
    whole = F.concat(F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){PROCLITICS}(?:"), each, F.lit(r")(?![\p{L}\p{N}_])"))
    return F.when(F.size(every) > 0, F.trim(F.regexp_replace(F.regexp_replace(text, whole, F.when(lang == "ar", PLACEHOLDER["ar"]).otherwise(PLACEHOLDER["en"])), r"\s{2,}", " "))).otherwise(text)


def sky(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SKY.items() for x in p)), code), F.lit("unknown"))


def weather(body: Column) -> Column:
    """struct of a provider's JSON: conditions, rounded numbers, the chance of rain in three hours, and flags for a driver."""
    b = F.from_json(body, WEATHER)
    now, ahead = b["current"], b["hourly"]
    said, rounded = sky(now["weather_code"]), lambda k: F.bround(now[k]).cast("int")
    km = F.bround(now["visibility"] / 1000, 1)
    rain = F.array_max(F.slice(ahead["precipitation_probability"], 1, 3))
    later = F.transform(F.slice(ahead["weather_code"], 1, 3), sky)
    flags = F.array(
        F.when(km < 1, "low visibility"), F.when(said.isin("fog", "freezing fog"), "fog"), F.when(rounded("wind_gusts_10m") >= 50, "gusts"),
        F.when(said.contains("rain") | said.contains("thunder") | F.coalesce(rain >= 60, F.lit(False)), "rain"), F.when(rounded("temperature_2m") >= 40, "heat"),
    )
    return F.struct(
        said.alias("conditions"), rounded("temperature_2m").alias("temp_c"), rounded("apparent_temperature").alias("feels_like_c"), rounded("wind_speed_10m").alias("wind_kmh"), rounded("wind_gusts_10m").alias("gusts_kmh"), km.alias("visibility_km"),
        rain.alias("rain_pct"), F.when(F.exists(later, lambda x: x != said), later).alias("next_hours"), F.array_compact(flags).alias("flags"),
    )


def retry_after(body: Column) -> Column:
    """Seconds to wait by a refusal's own words, with a little more, between 0.2 and 2.5; one without them."""
    n, unit = F.regexp_extract(body, r"try again in (\d+(?:\.\d+)?)\s*(ms|s)\b", 1), F.regexp_extract(body, r"try again in (\d+(?:\.\d+)?)\s*(ms|s)\b", 2)
    asked = F.try_to_number(n, F.lit("999999.999999")).cast("double") / F.when(unit == "ms", 1000).otherwise(1)
    return F.when(asked.isNull(), 1.0).otherwise(F.greatest(F.lit(0.2), F.least(asked + 0.15, F.lit(2.5))))


def streamed_reply(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, text, calls): what the ``data:`` lines of a streamed reply say, up to ``[DONE]``, in order, with tool calls put together by index."""
    data = F.trim(F.substring(F.col(line), 7, 1_000_000_000))
    read = lines.filter(F.col(line).startswith("data: ")).select(F.col(key).alias("k"), F.col(order).alias("o"), data.alias("d"))
    end = read.filter("d = '[DONE]'").groupBy(F.col("k").alias("ek")).agg(F.min("o").alias("stop"))
    live = read.join(end, F.col("k").eqNullSafe(F.col("ek")), "left").filter("stop is null or o < stop").select("k", "o", F.get(F.from_json("d", CHUNK)["choices"], F.lit(0))["delta"].alias("x"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", c.alias("v")))), lambda p: p["v"]), "")
    text = live.groupBy("k").agg(joined(F.coalesce(F.col("x.content"), F.lit(""))).alias("text"))
    parts = live.select("k", "o", F.explode("x.tool_calls").alias("c")).select("k", "o", F.coalesce("c.index", F.lit(0)).alias("i"), "c.id", F.coalesce("c.function.name", F.lit("")).alias("name"), F.coalesce("c.function.arguments", F.lit("")).alias("args"))
    last_id = F.max(F.when(F.col("id") != "", F.struct("o", "id")))["id"]
    calls = parts.groupBy("k", "i").agg(last_id.alias("id"), joined(F.col("name")).alias("name"), joined(F.col("args")).alias("args"))
    by_key = calls.groupBy(F.col("k").alias("ck")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id", "name", "args"))), lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["args"].alias("args"))).alias("calls"))
    return text.join(by_key, F.col("k").eqNullSafe(F.col("ck")), "left").select(F.col("k").alias(key), "text", "calls")
