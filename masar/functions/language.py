"""Which language a turn is in: evidence of either language, the turn's verdict, and the gate for replies, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masar.functions import speech

# Latin names and interjections that Arabic sentences carry, and Arabic names that English ones carry.
BORROWED_LATIN = ("ring road", "ring", "mehwar", "autostrad", "autostrad road", "corniche", "downtown", "tagamo", "tagamoa", "zayed", "october", "maadi", "nasr city", "heliopolis", "madinaty", "rehab", "shorouk", "obour", "master", "chillout", "chill out", "on the run", "circle k", "wataniya", "watanya", "misr petroleum", "totalenergies", "total", "mobil", "emarat misr", "cilantro", "costa", "starbucks", "dunkin", "beano", "beanos", "mcdonald", "mcdonalds", "kfc", "momen", "cook door", "buffalo burger", "el ezaby", "ezaby", "seif", "ok", "okay")
BORROWED_ARABIC = ("ماستر", "تشيل اوت", "شيل اوت", "اون ذا رن", "سيركل ك", "الوطنيه", "وطنيه", "مصر للبترول", "توتال", "موبيل", "امارات مصر", "سيلانترو", "كوستا", "ستاربكس", "دانكن", "بينوس", "ماكدونالدز", "كنتاكي", "مؤمن", "كوك دور", "بافلو برجر", "العزبي", "عزبي", "صيف", "الدائري", "المحور", "الاوتوستراد", "التجمع الخامس", "التجمع", "الشيخ زايد", "مدينتي", "الرحاب", "الشروق", "العبور", "مدينه نصر", "مصر الجديده", "المعادي", "وسط البلد", "العاصمه الاداريه", "اكتوبر", "الهرم", "المهندسين", "الزمالك")
#: English as an Arabic recognizer writes it.
TRANSLITERATED = ("هاو", "وات", "وير", "وين", "واي", "هوين", "ذا", "ذي", "ذيس", "ذات", "إز", "از", "إيز", "آر", "دو", "دوز", "دونت", "بليز", "ثانكس", "ثانك", "يو", "مي", "ماي", "تو", "فور", "فروم", "أند", "اند", "بت", "بات", "نوت", "يس", "نو", "تيك", "شو", "تيل", "جيت", "جو", "جوينج", "تيرن", "نيكست", "لفت", "رايت", "ستوب", "كانسل", "ميوت", "أنميوت", "لاودر", "ريبيت", "سويتش", "أفويد", "اسكيب", "ريمايند", "شير", "كول", "هوم", "وورك", "ورك", "لونج", "ليفت", "فار", "مني", "ماني", "سبيد", "ليميت", "فاست", "فاستر", "فاستست", "روود", "ستريت", "هايواي", "تول", "تولز", "إكسيت", "اكسيت", "بريدج", "ستيشن", "بيتزا", "أوردر", "بوك", "فلايت", "تايم", "أرايف", "ارايف", "أرايفنج", "مينتس", "مينت")
ARABIC_SHORT = ("لا", "لأ", "اه", "آه", "ده", "دي", "في", "من", "مش", "لو", "طب", "يا", "ما", "او", "أو", "هو", "هي", "كل", "عن", "بس")
PROSE = ("the", "is", "are", "in", "on", "at", "to", "and", "it", "you", "your", "there")
NOT_LETTERS = "٠-٩۰-۹؟،؛٪٫٬٭ـ«»"
UNSURE, UNSURE_AUDIO = 0.55, 0.35

#: Our own default: function words, numbers and what is said to a navigator.  A larger vocabulary is a parameter.
ENGLISH = (
    "a about after again all also an and another any anything are around as ask at away back be because been before best better but by can come could did different do does doing done don't each either else end enough even every far few find first for from get give go going good got great had half has have he hear help her here hey hi him his home how hurry i if in instead into is it its just keep know last late later left less let like little long look many me mean more most much must my near nearest need never new next no not nothing now of off often old on once one only open or other our out over past please quiet quick ready really right same say see she should show side since slow so some soon sorry start stay still stop such sure take talk tell ten than thank thanks that their them then there these they thing think this those through time to today too try turn two under until up us use usual very wait want was watch we were what when where which while who why will with work would wrong yes yesterday yet you your"
    " add alternative arrive avoid bridge camera cameras cancel city drive eta exit fast fastest gas hour map minutes mode mute road route routes share speed station street switch traffic english arabic entirely match wife voice stop entire remind remove parked wake"
).split()


def folded(text: Column) -> Column:
    """Lower case, with the forms of alef, ta marbuta and alef maqsura unified and without tatweel."""
    return F.translate(F.lower(text), "أإآةىـ", "اااهي")


def without(text: Column, names: Sequence[str]) -> Column:
    """The folded text with the names taken out, longer ones first, wherever they stand."""
    fold = str.maketrans("أإآةى", "اااهي", "ـ")
    every = sorted({n.lower().translate(fold) for n in names}, key=lambda n: (-len(n), n))
    return F.regexp_replace(folded(text), "|".join(every), " ")


def letters(text: Column) -> tuple[Column, Column]:
    """How many Arabic letters (digits and marks of the script are none) and how many ASCII letters."""
    return F.regexp_count(text, F.lit(f"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿&&[^{NOT_LETTERS}]]")), F.regexp_count(text, F.lit("[A-Za-z]"))


def junk(token: Column) -> Column:
    """One character over and over, or three Latin letters and more without a vowel."""
    return token.rlike(r"^(.)\1+$") | token.rlike("^[b-df-hj-np-tv-xz]{3,}$")


def english_evidence(text: Column, vocabulary: Sequence[str] = ENGLISH, borrowed: Sequence[str] = BORROWED_LATIN) -> Column:
    """struct<real, considered>: English words, and Latin tokens, among what is neither a borrowed name nor junk."""
    kept = F.filter(F.regexp_extract_all(without(text, borrowed), F.lit("([a-z][a-z']*)"), F.lit(1)), lambda t: ~junk(t))
    return F.struct(F.size(F.filter(kept, lambda t: F.btrim(t, F.lit("'")).isin(*vocabulary))).alias("real"), F.size(kept).alias("considered"))


def arabic_evidence(text: Column, borrowed: Sequence[str] = BORROWED_ARABIC) -> Column:
    """struct<real, considered, translit>: Arabic words, tokens, and tokens that are English in Arabic script."""
    tokens = F.regexp_extract_all(without(text, borrowed), F.lit("([؀-ۿ]+)"), F.lit(1))
    bare = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.regexp_replace(t, f"[{NOT_LETTERS}]", "").alias("b")))
    shaped = F.filter(bare, lambda x: (F.char_length(x["b"]) >= 2) & ~junk(x["b"]))
    english = lambda x: x["t"].isin(*TRANSLITERATED) | (x["t"].startswith("ال") & (F.char_length(x["t"]) > 4) & F.substring(x["t"], 3, 100_000).isin(*TRANSLITERATED))
    short = sorted({w.translate(str.maketrans("أإآةى", "اااهي")) for w in ARABIC_SHORT})
    real = F.filter(shaped, lambda x: ~english(x) & ((F.char_length(x["b"]) > 2) | x["b"].isin(*short)))
    return F.struct(F.size(real).alias("real"), F.size(tokens).alias("considered"), F.size(F.filter(shaped, english)).alias("translit"))


def mostly_transliterated(arabic: Column) -> Column:
    """Two such words or more, and three in five of the words that count."""
    return (arabic["translit"] >= 2) & (arabic["translit"] >= 0.6 * F.greatest(F.lit(1), arabic["real"] + arabic["translit"]))


def with_verdict(turns: DataFrame, text: str, verdict: str, vocabulary: Sequence[str] = ENGLISH) -> DataFrame:
    """Adds struct<lang, source, arabizi, vague>: what the words alone say.  lang is null where they leave it to the conversation.

    vague: where nothing can be made of what letters there are.  A null text is an empty one.
    """
    whole = F.trim(F.coalesce(F.col(text), F.lit("")))
    ar, la = letters(whole)
    own_ar, own_la = letters(without(whole, BORROWED_ARABIC))[0], letters(without(whole, BORROWED_LATIN))[1]
    facts = F.struct(
        speech.asked_language(whole).alias("asked"), ar.alias("ar"), la.alias("la"), speech.is_arabizi(whole).alias("arabizi"), english_evidence(whole, vocabulary).alias("en"), arabic_evidence(whole).alias("arab"),
        (own_ar / F.greatest(F.lit(1), own_ar + own_la)).alias("share"), (whole == "").alias("empty"),
    )
    f = F.col(verdict)
    english = (f["en"]["real"] >= 1) & ((f["en"]["real"] >= 2) | (f["en"]["considered"] <= 2)) & (f["en"]["real"] >= 0.4 * F.greatest(F.lit(1), f["en"]["considered"]))
    arabic = f["arab"]["real"] >= 1
    latin_arabic = (f["la"] > 0) & (f["ar"] == 0) & f["arabizi"]
    translit = (f["ar"] > 0) & mostly_transliterated(f["arab"])
    frame = (
        F.when(english & ~arabic, "en").when(arabic & ~english, "ar").when(f["arab"]["real"] > f["en"]["real"], "ar").when(f["en"]["real"] > f["arab"]["real"], "en")
        .when(f["share"] >= 0.6, "ar").when(f["share"] <= 0.4, "en").when(f["arab"]["real"] >= 2, "ar")
    )
    none = ~english & ~arabic
    lang = F.when(f["empty"], None).when(f["asked"].isNotNull(), f["asked"]).when(latin_arabic, "ar").when(translit, "en").when(none, None).otherwise(frame)
    source = F.when(f["empty"], "fallback").when(f["asked"].isNotNull(), "explicit").when(latin_arabic, "arabizi").when(translit, "translit").when(none, "fallback").otherwise("evidence")
    decided = F.struct(lang.alias("lang"), source.alias("source"), (latin_arabic & f["asked"].isNull()).alias("arabizi"), (none & ~f["empty"] & f["asked"].isNull() & ~latin_arabic & ~translit & (f["ar"] + f["la"] > 0)).alias("vague"), translit.alias("translit"))
    return turns.withColumn(verdict, facts).withColumn(verdict, decided)


def resolved(verdict: Column, before: Column, app: Column, confidence: Column | None = None) -> Column:
    """struct<lang, source, arabizi, unreliable>: the turn's language after the conversation's (``before``) and the app's.

    A change under an unsure transcript is refused, unless it was asked for or is Arabic in Latin letters.
    """
    known = lambda c: F.when(c.isin("ar", "en"), c)
    prev, unsure = known(before), F.coalesce(confidence < UNSURE, F.lit(False)) if confidence is not None else F.lit(False)
    stay = F.coalesce(prev, known(app), F.lit("en"))
    open_ = verdict["lang"].isNull()
    gray = open_ & (verdict["source"] == "evidence")
    guarded = verdict["source"].isin("translit", "evidence") & ~open_ & (verdict["lang"] != prev) & unsure
    lang = F.when(gray, F.coalesce(prev, F.lit("ar"))).when(open_, stay).when(guarded, prev).otherwise(verdict["lang"])
    source = F.when(open_ & prev.isNotNull() & (verdict["vague"] | (verdict["source"] == "evidence")), "sticky").when(F.coalesce(guarded, F.lit(False)), "guard").otherwise(verdict["source"])
    unreliable = verdict["vague"] | F.coalesce(guarded, F.lit(False)) | verdict["translit"] | (open_ & unsure)
    return F.struct(lang.alias("lang"), source.alias("source"), verdict["arabizi"].alias("arabizi"), unreliable.alias("unreliable"))


def resolve_conversations(turns: DataFrame, conv: str, turn: str, text: str, app: str = "en", vocabulary: Sequence[str] = ENGLISH) -> DataFrame:
    """Adds lang and source to each turn: a turn that doesn't say keeps the language of the last that did.

    The first turn falls back on the app's language, or on Arabic where both languages are equally there.
    """
    said = with_verdict(turns, text, "_verdict", vocabulary)
    so_far = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.when(F.first("_verdict.source").over(so_far) == "evidence", "ar").otherwise(app)
    decided = F.last("_verdict.lang", ignorenulls=True).over(so_far)
    source = F.when(F.col("_verdict.lang").isNotNull(), F.col("_verdict.source")).when(F.row_number().over(Window.partitionBy(conv).orderBy(turn)) > 1, "sticky").otherwise("fallback")
    return said.withColumns({"lang": F.coalesce(decided, first), "source": source}).drop("_verdict")


def reply_fits(text: Column, lang: Column, least: float = 0.5) -> Column:
    """Whether a reply is in the language: half of its letters without borrowed names, or no more than a name."""
    whole = F.coalesce(text, F.lit(""))
    ar_share, en_share = letters(without(whole, BORROWED_LATIN)), letters(without(whole, BORROWED_ARABIC))
    part = F.when(lang == "ar", F.try_divide(ar_share[0], ar_share[0] + ar_share[1])).otherwise(F.try_divide(en_share[1], en_share[0] + en_share[1]))
    ar, la = letters(whole)
    own = F.when(lang == "ar", ar).otherwise(la)
    latin = F.regexp_extract_all(whole, F.lit("([A-Za-z][A-Za-z'’.-]*)"), F.lit(1))
    proper = (F.size(latin) > 0) & (F.size(latin) <= 4) & F.forall(latin, lambda w: w.rlike("^[A-Z]") | F.btrim(F.lower(w), F.lit(".,!?'’-")).isin(*BORROWED_LATIN))
    few = (F.size(F.regexp_extract_all(whole, F.lit(r"(\S+)"), F.lit(1))) <= 4) & ~F.exists(F.split(folded(whole), " "), lambda w: w.isin(*PROSE))
    return (F.trim(whole) == "") | (F.coalesce(part, F.lit(1.0)) >= least) | F.when(own == 0, (lang == "ar") & proper).otherwise(few)
