"""What a driver's utterance asks for, and the answers that need no model, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each question, of words that ask for an action or a place, and of traffic.
ACTION_WORDS = r"(add|stop\b|station|pharmacy|atm|restaurant|cafe|coffee|mosque|hospital|parking|switch|change|avoid|reroute|route to|take me|go to|navigate|home\b|work\b|mute|unmute|volume|report|share|remind|call|cancel|بنزينه|بنزينة|محطه|محطة|صيدليه|صيدلية|مطعم|كافيه|قهوه|قهوة|جامع|مسجد|مستشفى|موقف|جراج|ضيف|اضف|زود|حول|بدل|غير|شيل|الغي|ألغي|وقف|روح|خدني|وديني|اقفل|افتح|اعمل|بلغ|ابعت|فكرني|اتصل|كلم)"
TRAFFIC_WORDS = r"(traffic|jam|congestion|زحمه|زحمة|زحام|عربيات)"
QUESTIONS = {
    "cameras_count": (r"how many (speed )?(camera|cameras|radar|radars)", r"(كام|عدد) (رادار|كاميرا|الرادارات|الكاميرات)", r"(رادار|كاميرا)\S* (كام|قد ايه)", r"(في|فيه|فى) (رادارات|كاميرات|رادار)"),
    "next_camera": (r"(where|how far).{0,12}(next )?(camera|radar)", r"(next|nearest|closest) (camera|radar)", r"(فين|بعد كام|علي بعد كام|على بعد كام).{0,10}(رادار|كاميرا)", r"(الرادار|الكاميرا) (الجاي|الجايه|الجاية|القادم|فين)"),
    "speed_limit": (r"(what('|’)?s|whats|what is) the speed limit", r"^speed limit\??$", r"(السرعه|السرعة) (القصوى|المسموحه|المسموحة|المسموح)", r"حد السرعه|حد السرعة|اقصى سرعه|أقصى سرعة"),
    "current_speed": (r"(how fast am i|what('|’)?s my speed|whats my speed|what is my speed)", r"(سرعتي|سرعتى) كام", r"ماشي بكام|ماشى بكام"),
    "current_road": (r"(what|which) (road|street) (am i on|is this)", r"(انا|إحنا|احنا) (في|فى|علي|على) (شارع|طريق) (ايه|إيه|مين)", r"(الشارع|الطريق) (ده|دا) (اسمه ايه|ايه|إيه)", r"(ماشي|ماشى|ماشيين) (في|فى|علي|على) (ايه|إيه|فين)"),
    "next_turn": (r"(what('|’)?s|whats|what is) (my |the )?next (turn|maneuver|exit)", r"where do i turn", r"^next turn\??$", r"(الف|ألف|هلف|احول|أحول|اخش|أخش) فين", r"(اللفه|اللفة|الحركه|الحركة|الخروجه|الخروجة|المخرج) (الجايه|الجاية|الجاي|القادمه|القادمة|فين)", r"بعد كام (الف|ألف|لفه|لفة)"),
    "arrival_time": (r"(what time|when) (will|do) (i|we) (arrive|get there|reach)", r"arrival time", r"(هوصل|هنوصل|نوصل) (الساعه|الساعة) كام", r"(هوصل|هنوصل) امتي|(هوصل|هنوصل) امتى|(هوصل|هنوصل) إمتى"),
    "eta_remaining": (r"how (long|much longer|much time)( is)?( left| remaining| to go)?\??$", r"how long (till|until|before) (i|we) (arrive|get)", r"(time|minutes) (left|remaining)", r"^(what('|’)?s the |whats the )?eta\??$", r"(فاضل|باقي|باقى|فاضلي|فاضللي) (كام|قد ايه|اد ايه)(?! (كيلو|كم))", r"(كام|قد ايه) (فاضل|باقي|باقى)(?! (كيلو|كم))", r"الوقت (المتبقي|المتبقى|الباقي|الباقى)"),
    "incident_ahead": (r"(is there|any|see|got) (an |a )?(accident|crash|collision|police|checkpoint|hazard|incident)", r"(accident|crash|police|checkpoint|hazard) (ahead|up ahead|on the road|on my way)", r"(فيه|في|فى) (حادثة|حادثه|حوادث|كمين|كمائن|لجنة|لجنه|خطر)", r"(حادثة|حادثه|كمين|لجنة|لجنه) (قدامي|قدامى|قدام|على الطريق|في الطريق|فى الطريق)"),
    "distance_remaining": (r"how far( left| to go| is it| remaining)?\??$", r"(distance|km|kilometers) (left|remaining|to go)", r"(فاضل|باقي|باقى) كام (كيلو|كم)", r"كام كيلو (فاضل|باقي|باقى)", r"(المسافه|المسافة) (المتبقيه|المتبقية|الباقيه|الباقية|كام)"),
}
NOT_OF_TRAFFIC = ("eta_remaining", "distance_remaining", "arrival_time")
# Whole commands and the actions they start, thanks, sign-offs, and answers to a question.
ACTIONS = {
    "ack_muted": ('{"type":"set_guidance_voice","muted":true,"requires_confirm":false}', (r"^(mute|mute (the )?(voice|guidance|sound|navigation)|voice off|turn (the )?(voice|sound) off|silence( the voice)?)$", r"^(اقفل|أقفل|وقف|وقّف|سكت|سكّت|اسكت|إسكت) (الصوت|صوتك)$", r"^(اسكت|إسكت)$")),
    "ack_unmuted": ('{"type":"set_guidance_voice","muted":false,"requires_confirm":false}', (r"^(unmute|voice on|turn (the )?(voice|sound) (back )?on|speak again)$", r"^(افتح|إفتح|رجع|رجّع|شغل|شغّل) (الصوت|صوتك)( تاني)?$")),
    "ack_repeat": ('{"type":"repeat_instruction","requires_confirm":false,"commit":"done"}', (r"^(repeat( that| it)?|say (that|it) again|what did you say|come again|again please|repeat the instruction)$", r"^(قول تاني|قولها تاني|عيد|عيد تاني|عيدها|كرر|كرّر|قلت ايه|قلت إيه|ايه قلت|إيه قلت)$")),
    "ack_louder": ('{"type":"set_voice_volume","direction":"louder","requires_confirm":false,"commit":"done"}', (r"^(louder|turn it up|volume up|speak up|a bit louder|louder please)$", r"^(علي|على|علّي|ارفع|إرفع|زود|زوّد) (الصوت|صوتك)( شوية| شويه)?$")),
    "ack_quieter": ('{"type":"set_voice_volume","direction":"quieter","requires_confirm":false,"commit":"done"}', (r"^(quieter|turn it down|volume down|lower the volume|softer|a bit quieter|not so loud)$", r"^(وطي|وطّي|وطى|قلل|قلّل|نزل|نزّل|هدي|هدّي) (الصوت|صوتك)( شوية| شويه)?$")),
}
POLITE = r"(?i)\b(please|plz)\b|لو سمحت|من فضلك|يا باشا|يا معلم|بالله"
THANKS = (r"^(thanks|thank you|thank u|thx|ty|cheers|thanks a lot|thank you so much|thanks man|thanks bro|great thanks|ok thanks|okay thanks|perfect thanks)$", r"^(شكرا|شكراً|شكرًا|متشكر|متشكره|متشكرة|تسلم|تسلمي|تسلم ايدك|تسلم إيدك|ميرسي|مرسي|الله يخليك|ربنا يخليك|شكرا جدا|شكرا ليك|تمام شكرا|ماشي شكرا)$")
CLOSERS = (r"^(that'?s all|that'?s it|that is all|nothing( else)?|no thanks|no thank you|never ?mind|forget it|bye|bye bye|goodbye|see you|see ya|all good|i'?m good|we'?re good|all set)$", r"^(خلاص|خلاص كده|خلاص كدا|خلاص كده تمام|كده تمام|كدا تمام|تمام كده|لا شكرا|لا شكرًا|مش عايز حاجه|مش عايز حاجة|مش عاوز حاجه|مش عاوز حاجة|ولا حاجه|ولا حاجة|انسى|انسي|انسى الموضوع|سيبك|سيبك منها|سلام|سلام عليكم|مع السلامه|مع السلامة|باي|يلا سلام)$")
YES = ("yes", "yeah", "yep", "yup", "sure", "ok", "okay", "confirm", "do it", "go ahead", "add it", "switch", "alright", "ايوه", "ايوة", "اه", "نعم", "تمام", "ماشي", "موافق", "اوك", "اوكي", "يلا", "اكيد", "ضيفها", "ضيفه", "بدل")
NO = ("no", "nope", "cancel", "don't", "dont", "never mind", "لا", "لأ", "بلاش", "الغاء", "الغيه", "مش عايز", "مش عاوز", "خلاص لا")
FILLERS = ("thanks", "thank you", "شكرا", "شكرًا", "يا باشا", "يا معلم", "خلاص", "بقى", "بقي")
#: What is known of the trip under way.
CONTEXT = "eta_min int, remaining_time_min int, remaining_km double, remaining_distance_km double, speed_kmh double, speed_limit_kmh double, current_road string, next_maneuver string, next_maneuver_m double, local_time string, cameras_ahead array<struct<distance_ahead_km:double,distance_km:double,limit_kmh:double,limit:double>>, traffic_segments array<struct<level:string,distance_ahead_km:double,road:string>>"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def _only(named: dict[str, Column]) -> Column:
    """The name of the one condition that holds; null for none or several."""
    held = F.array_compact(F.array(*(F.when(c, n) for n, c in named.items())))
    return F.when(F.size(held) == 1, F.get(held, F.lit(0)))


def intent(text: Column, most_words: int = 9) -> Column:
    """The one question that an utterance asks; null where it is long, wants an action or a place, or asks several."""
    t = _squeezed(text)
    plain = {n: _any(t, p) & (~t.rlike(TRAFFIC_WORDS) if n in NOT_OF_TRAFFIC else F.lit(True)) for n, p in QUESTIONS.items()}
    return F.when((t != "") & (_count(t) <= most_words) & ~t.rlike(ACTION_WORDS), _only(plain))


def _command(text: Column) -> Column:
    """Without politeness and trailing marks."""
    return F.trim(F.regexp_replace(_squeezed(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), POLITE, " ")), r"[\s.!?؟،,…]+$", ""))


def action(text: Column) -> Column:
    """struct<ack, action (JSON)> of a whole command of five words or fewer; null otherwise."""
    t = _command(text)
    name = F.when((t != "") & (_count(t) <= 5), _only({n: _any(t, p) for n, (_, p) in ACTIONS.items()}))
    what = reduce(lambda rest, n: F.when(name == n, ACTIONS[n][0]).otherwise(rest), ACTIONS, F.lit(None).cast("string"))
    return F.when(name.isNotNull(), F.struct(name.alias("ack"), what.alias("action")))


def thanks(text: Column) -> Column:
    t = _command(text)
    return F.when((t != "") & (_count(t) <= 4) & _any(t, THANKS), "ack_thanks")


def closer(text: Column) -> Column:
    t = _command(text)
    return F.when((t != "") & (_count(t) <= 4) & _any(t, CLOSERS), "ack_bye")


def yes_no(text: Column) -> Column:
    """'yes' or 'no' where an utterance of three words or fewer is nothing else; null otherwise."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "أإآ", "ااا")
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, POLITE, " "), r"[.!?؟،,…]", " "), r"\s+", " "))
    longest = sorted({*YES, *NO, *FILLERS}, key=lambda w: (-len(w), w))
    spaced = F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" "))  # so that neighbours don't share a blank
    has = lambda ws: _any(F.concat(F.lit(" "), t, F.lit(" ")), [f" (?:{'|'.join(ws)}) "])
    left = F.trim(F.regexp_replace(spaced, "|".join(" " + w.replace(" ", "  ") + " " for w in longest), " "))
    said = F.when(has(YES) & ~has(NO), "yes").when(has(NO) & ~has(YES), "no")
    return F.when((t != "") & (_count(t) <= 3) & (left == ""), said)


def _number(n: Column) -> Column:
    return n.cast("int").cast("string")


def said_minutes(minutes: Column, lang: Column) -> Column:
    """A duration as it is said: hours from an hour and a half on, halves, and the Arabic dual and plurals."""
    m = F.greatest(F.lit(0), F.bround(minutes).cast("int"))
    h, left = F.floor(m / 60).cast("int"), m % 60
    few_ar = lambda k: F.when(k == 0, "أقل من دقيقة").when(k == 1, "دقيقة").when(k == 2, "دقيقتين").when(k <= 10, F.concat(_number(k), F.lit(" دقايق"))).otherwise(F.concat(_number(k), F.lit(" دقيقة")))
    few_en = F.when(m == 0, "under a minute").when(m == 1, "a minute").otherwise(F.concat(_number(m), F.lit(" minutes")))
    hours_ar = F.when(h == 1, "ساعة").when(h == 2, "ساعتين").otherwise(F.concat(_number(h), F.lit(" ساعات")))
    hours_en = F.when(h == 1, "an hour").otherwise(F.concat(_number(h), F.lit(" hours")))
    half = left.between(25, 35)
    long_ar = F.when(half, F.concat(hours_ar, F.lit(" ونص"))).when(left >= 10, F.concat(hours_ar, F.lit(" و"), few_ar(left))).otherwise(hours_ar)
    long_en = F.when(half, F.concat(hours_en, F.lit(" and a half"))).when(left >= 10, F.concat(hours_en, F.lit(" and "), _number(left), F.lit(" minutes"))).otherwise(hours_en)
    return F.when(lang == "ar", F.when(m >= 90, long_ar).otherwise(few_ar(m))).otherwise(F.when(m >= 90, long_en).otherwise(few_en))


def said_distance(km: Column, lang: Column) -> Column:
    """A distance rounded for the ear: fifties of metres, then halves of kilometres, then whole ones."""
    metres = F.greatest(F.lit(50), F.bround(km * 20).cast("int") * 50)
    halves = F.bround(km * 2).cast("int")
    whole, odd, far = F.floor(halves / 2).cast("int"), halves % 2 == 1, F.bround(km).cast("int")
    said = lambda n, unit: F.concat(_number(n), F.lit(f" {unit}"))
    mid_ar = F.when(odd & (whole == 0), "نص كيلو").when(odd & (whole == 1), "كيلو ونص").when(odd, said(whole, "كيلو ونص")).when(whole == 1, "كيلومتر").when(whole == 2, "كيلومترين").otherwise(said(whole, "كيلومترات"))
    mid_en = F.when(odd & (whole == 0), "half a kilometer").when(odd & (whole == 1), "a kilometer and a half").when(odd, said(whole, "and a half kilometers")).when(whole == 1, "a kilometer").otherwise(said(whole, "kilometers"))
    ar = F.when(km < 0.975, said(metres, "متر")).when(km < 9.75, mid_ar).otherwise(said(far, "كيلومتر"))
    en = F.when(km < 0.975, said(metres, "meters")).when(km < 9.75, mid_en).otherwise(said(far, "kilometers"))
    return F.when(km.isNotNull(), F.when(lang == "ar", ar).otherwise(en))


def clock_after(local: Column, minutes: Column) -> Column:
    """The time of day so many minutes after ``H:MM``; null where that is no time."""
    total = (F.try_element_at(F.split(local, ":"), F.lit(1)).cast("int") * 60 + F.try_element_at(F.split(local, ":"), F.lit(2)).cast("int") + minutes.cast("int")) % 1440
    return F.when(F.trim(local).rlike(r"^\d{1,2}:\d{2}$"), F.format_string("%d:%02d", F.floor(total / 60).cast("int"), total % 60))


def clock_12(time: Column) -> Column:
    hour = F.split(time, ":")[0].cast("int")
    return F.concat(F.coalesce(F.nullif(hour % 12, F.lit(0)), F.lit(12)).cast("string"), F.lit(":"), F.split(time, ":")[1], F.when(hour < 12, " am").otherwise(" pm"))


def answer(intent: Column, ctx: Column, lang: Column) -> Column:
    """What is said to a question from the trip's context (a struct of CONTEXT); null where the context can't tell."""
    ar = lang == "ar"
    both = lambda a, e: F.when(ar, a).otherwise(e)
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))
    if_there = lambda c, *parts: F.when(c.isNotNull(), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    cams = ctx["cameras_ahead"]
    n, first = F.size(cams), F.get(cams, F.lit(0))
    away = said_distance(F.coalesce(first["distance_ahead_km"], first["distance_km"]), lang)
    limit = F.nullif(F.coalesce(first["limit_kmh"], first["limit"]), F.lit(0.0))
    radars = F.when(n == 1, "رادار واحد").when(n == 2, "رادارين").when(n <= 10, F.concat(_number(n), F.lit(" رادارات"))).otherwise(F.concat(_number(n), F.lit(" رادار")))
    at_most = both(if_there(limit, "، والسرعة عنده ", _number(limit)), if_there(limit, ", limit ", _number(limit)))
    counted = both(join("قدامك ", radars, if_there(away, " — أقربهم بعد ", away, " تقريبًا"), at_most, "."), join(_number(n), " camera", F.when(n != 1, "s"), " ahead", if_there(away, " — the nearest in about ", away), at_most, "."))
    next_one = F.when(away.isNotNull(), both(join("الرادار الجاي بعد ", away, " تقريبًا", at_most, "."), join("Next camera in about ", away, at_most, ".")))
    posted, speed = ctx["speed_limit_kmh"], ctx["speed_kmh"]
    over = F.coalesce(speed > posted + 3, F.lit(False))
    posted_said = F.when(posted.isNull(), both("مفيش حد سرعة معروف للطريق ده.", "No posted speed-limit data for this road.")).otherwise(
        both(join("أقصى سرعة هنا ", _number(posted), F.when(over, " — وانت عديها شوية، خد بالك"), "."), join("The limit here is ", _number(posted), F.when(over, " — you're a bit over it"), "."))
    )
    eta = F.coalesce(ctx["eta_min"], ctx["remaining_time_min"])
    clock, left = clock_after(ctx["local_time"], eta), said_minutes(eta, lang)
    km = F.coalesce(ctx["remaining_km"], ctx["remaining_distance_km"])
    turn, turn_km = F.nullif(ctx["next_maneuver"], F.lit("")), said_distance(ctx["next_maneuver_m"] / 1000, lang)
    in_script = F.when(ar, ~turn.rlike("[A-Za-z]")).otherwise(~turn.rlike("[ء-ي]"))
    heavy = F.get(F.filter(ctx["traffic_segments"], lambda s: F.lower(s["level"]).isin("heavy", "severe", "jam")), F.lit(0))
    jam_km = said_distance(heavy["distance_ahead_km"], lang)
    road = F.nullif(heavy["road"], F.lit(""))
    jam = both(if_there(heavy, "، بس فيه زحمة تقيلة", join(if_there(jam_km, " بعد ", jam_km)), join(if_there(road, " على ", road))), if_there(heavy, ", but there's heavy traffic", join(if_there(jam_km, " in about ", jam_km)), join(if_there(road, " on ", road))))
    said = {
        "cameras_count": F.when(n == 0, both("مفيش رادارات على باقي طريقك.", "No speed cameras on the rest of your route.")).when(n > 0, counted),
        "next_camera": F.when(n == 0, both("مفيش رادارات قدامك على الطريق.", "No cameras ahead on your route.")).when(n > 0, next_one),
        "speed_limit": posted_said,
        "current_speed": if_there(speed, both("سرعتك حوالي ", "You're doing about "), _number(F.bround(speed)), both(" كيلومتر في الساعة.", " kilometers per hour.")),
        "current_road": if_there(F.nullif(ctx["current_road"], F.lit("")), both("انت ماشي على ", "You're on "), ctx["current_road"], "."),
        "next_turn": F.when(in_script, F.when(turn_km.isNull(), both(join("اللفة الجاية: ", turn, "."), join("Next up: ", turn, "."))).otherwise(both(join("بعد ", turn_km, " تقريبًا: ", turn, "."), join("In about ", turn_km, ": ", turn, ".")))),
        "arrival_time": F.when(clock.isNotNull(), both(join("هتوصل حوالي الساعة ", clock, "."), join("You'll arrive around ", clock_12(clock), "."))).when(eta.isNotNull(), both(join("فاضل ", left, " تقريبًا."), join("About ", left, " to go."))),
        "eta_remaining": F.when(eta.isNotNull(), both(join("فاضل ", left, " تقريبًا", if_there(clock, "، هتوصل حوالي ", clock), "."), join("About ", left, " to go", if_there(clock, ", arriving around ", clock_12(clock)), "."))),
        "incident_ahead": join(both("مش شايف حوادث ولا كمائن في بيانات الرحلة", "I don't see any incidents in the trip data"), jam, "."),
        "distance_remaining": F.when(km.isNotNull(), both(join("فاضل ", said_distance(km, lang), " تقريبًا."), join("About ", said_distance(km, lang), " to go."))),
    }
    return reduce(lambda rest, k: F.when(intent == k, said[k]).otherwise(rest), said, F.lit(None).cast("string"))
