"""Queries of what is said and heard: languages, questions, commands, answers, wording, transcripts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masar.functions import intents as I
from masar.functions import jsontree as J
from masar.functions import language as L
from masar.functions import speech as Z
from masar.functions import talk as T
from masar.functions import text as X
from masar.plans.registry import query, table


def _list(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _fold(col: str) -> str:
    return f"translate(lower({col}), 'أإآةىـ', 'اااهي')"


def _without(col: str, names: Iterable[str]) -> str:
    every = sorted({n.lower().translate(str.maketrans("أإآةى", "اااهي", "ـ")) for n in names}, key=lambda n: (-len(n), n))
    return f"regexp_replace({_fold(col)}, {_rx('|'.join(every))}, ' ', 'g')"


def _ar(col: str) -> str:
    return f"length(regexp_replace(regexp_replace({col}, '[{L.NOT_LETTERS}]', '', 'g'), '[^؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]', '', 'g'))"


def _la(col: str) -> str:
    return f"length(regexp_replace({col}, '[^A-Za-z]', '', 'g'))"


_JUNK = "((length(t) >= 2 AND replace(t, substr(t, 1, 1), '') = '') OR regexp_matches(t, '^[b-df-hj-np-tv-xz]{3,}$'))"
_EN = f"""(SELECT conv_id, turn, text, len(list_filter(kept, lambda t: trim(t, '''') IN ({_list(L.ENGLISH)}))) AS en_real, len(kept) AS en_n
  FROM (SELECT conv_id, turn, text, list_filter(regexp_extract_all({_without('text', L.BORROWED_LATIN)}, '[a-z][a-z'']*'), lambda t: NOT {_JUNK}) AS kept FROM conversations))"""
_ENGLISH_IN_ARABIC = f"(x.t IN ({_list(L.TRANSLITERATED)}) OR (starts_with(x.t, 'ال') AND length(x.t) > 4 AND substr(x.t, 3) IN ({_list(L.TRANSLITERATED)})))"
_AR = f"""(SELECT conv_id, turn, len(toks) AS ar_n, len(list_filter(shaped, lambda x: {_ENGLISH_IN_ARABIC})) AS translit,
    len(list_filter(shaped, lambda x: NOT {_ENGLISH_IN_ARABIC} AND (length(x.b) > 2 OR x.b IN ({_list(sorted({w.translate(str.maketrans('أإآةى', 'اااهي')) for w in L.ARABIC_SHORT}))})))) AS ar_real
  FROM (SELECT conv_id, turn, toks, list_filter(list_transform(toks, lambda t: {{'t': t, 'b': regexp_replace(t, '[{L.NOT_LETTERS}]', '', 'g')}}), lambda x: length(x.b) >= 2 AND replace(x.b, substr(x.b, 1, 1), '') <> '') AS shaped
    FROM (SELECT conv_id, turn, regexp_extract_all({_without('text', L.BORROWED_ARABIC)}, '[؀-ۿ]+') AS toks FROM conversations)))"""
_ARABIZI = f"""(SELECT conv_id, turn, list_sum(list_transform(ws, lambda w: CASE WHEN w IN ({_list(Z.STRONG)}) OR (regexp_matches(w, {_rx('|'.join(Z.DIGIT_SHAPES))}) AND w NOT IN ({_list(Z.ORDINALS)})) THEN 2 WHEN w IN ({_list(Z.COMMON)}) THEN 1 ELSE 0 END)) >= CASE WHEN len(ws) > 2 THEN 2 ELSE 1 END AS arabizi
  FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '([a-z0-9'']+)', 1) AS ws FROM conversations))"""


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("tx_evidence_en", f"SELECT conv_id, turn, en_real AS real, en_n AS considered FROM {_EN}")
def evidence_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("conv_id", "turn", L.english_evidence(F.col("text")).alias("e")).select("conv_id", "turn", F.col("e.real").cast("long").alias("real"), F.col("e.considered").cast("long").alias("considered"))


@query("tx_evidence_ar", f"SELECT conv_id, turn, ar_real AS real, ar_n AS considered, translit FROM {_AR}")
def evidence_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = talk(spark, sf_dir).select("conv_id", "turn", L.arabic_evidence(F.col("text")).alias("e"))
    return e.select("conv_id", "turn", *(F.col(f"e.{k}").cast("long").alias(k) for k in ("real", "considered", "translit")))


@query("tx_translit", f"SELECT conv_id, turn, translit >= 2 AND translit >= 0.6*greatest(1, ar_real + translit) AS translit FROM {_AR}")
def translit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("conv_id", "turn", L.mostly_transliterated(L.arabic_evidence(F.col("text"))).alias("translit"))


@query("tx_resolve_lang", f"""
WITH f AS (
  SELECT conv_id, turn, text, en_real, en_n, ar_real, ar_real >= 1 AS ar_ok, en_real >= 1 AND (en_real >= 2 OR en_n <= 2) AND en_real >= 0.4*greatest(1, en_n) AS en_ok, translit >= 2 AND translit >= 0.6*greatest(1, ar_real + translit) AS translit, coalesce(arabizi, false) AS arabizi,
         CASE WHEN regexp_matches(lower(text), {_rx(Z.ASK_ENGLISH)}) THEN 'en' WHEN regexp_matches(lower(text), {_rx(Z.ASK_ARABIC)}) THEN 'ar' END AS asked, {_ar('text')} AS ar, {_la('text')} AS la, {_ar(_without('text', L.BORROWED_ARABIC))} AS own_ar, {_la(_without('text', L.BORROWED_LATIN))} AS own_la
  FROM {_EN} JOIN {_AR} USING (conv_id, turn) JOIN {_ARABIZI} USING (conv_id, turn)),
d AS (
  SELECT conv_id, turn, asked IS NULL AND NOT (la > 0 AND ar = 0 AND arabizi) AND NOT (ar > 0 AND translit) AND (en_ok OR ar_ok) AS framed,
         CASE WHEN trim(text) = '' THEN NULL WHEN asked IS NOT NULL THEN asked WHEN la > 0 AND ar = 0 AND arabizi THEN 'ar' WHEN ar > 0 AND translit THEN 'en' WHEN NOT en_ok AND NOT ar_ok THEN NULL
              WHEN en_ok AND NOT ar_ok THEN 'en' WHEN ar_ok AND NOT en_ok THEN 'ar' WHEN ar_real > en_real THEN 'ar' WHEN en_real > ar_real THEN 'en' WHEN own_ar >= 0.6*greatest(1, own_ar + own_la) THEN 'ar' WHEN own_ar <= 0.4*greatest(1, own_ar + own_la) THEN 'en' WHEN ar_real >= 2 THEN 'ar' END AS lang FROM f)
SELECT conv_id, turn, coalesce(last_value(lang IGNORE NULLS) OVER w, CASE WHEN first_value(framed) OVER w THEN 'ar' ELSE 'en' END) AS lang FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def resolve_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each turn: what the words say, else the conversation's."""
    return L.resolve_conversations(talk(spark, sf_dir), "conv_id", "turn", "text").select("conv_id", "turn", "lang")


_PROSE = f"len(list_filter(string_split({_fold('text')}, ' '), lambda w: w IN ({_list(L.PROSE)}))) = 0"


@query("tx_reply_gate", f"""
WITH g AS (SELECT conv_id, turn, text, {_ar('text')} AS ar, {_la('text')} AS la, {_ar(_without('text', L.BORROWED_ARABIC))} AS e_ar, {_la(_without('text', L.BORROWED_ARABIC))} AS e_la, {_ar(_without('text', L.BORROWED_LATIN))} AS a_ar, {_la(_without('text', L.BORROWED_LATIN))} AS a_la,
  regexp_extract_all(text, '[A-Za-z][A-Za-z''’.-]*') AS latin, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n FROM conversations),
p AS (SELECT *, len(latin) BETWEEN 1 AND 4 AND len(list_filter(latin, lambda w: NOT regexp_matches(w, '^[A-Z]') AND trim(lower(w), '.,!?''’-') NOT IN ({_list(L.BORROWED_LATIN)}))) = 0 AS proper, n <= 4 AND {_PROSE} AS few FROM g)
SELECT conv_id, turn, trim(text) = '' OR e_ar + e_la = 0 OR e_la >= 0.5*(e_ar + e_la) OR (la > 0 AND few) AS en_ok, trim(text) = '' OR a_ar + a_la = 0 OR a_ar >= 0.5*(a_ar + a_la) OR CASE WHEN ar = 0 THEN proper ELSE few END AS ar_ok FROM p""")
def reply_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turn would pass as a reply in either language."""
    return talk(spark, sf_dir).select("conv_id", "turn", L.reply_fits(F.col("text"), F.lit("en")).alias("en_ok"), L.reply_fits(F.col("text"), F.lit("ar")).alias("ar_ok"))


#: Utterances over the synthetic turns: each names a question, a command, thanks, a sign-off or an answer, or is the turn itself.
SAYINGS = ("how many cameras ahead", "what's the speed limit", "how long left", "how far to go", "what time will i arrive", "Mute the voice.", "louder please", "repeat that", "Thanks!", "that's all", "yes please", "no thanks", "is there an accident ahead", "what road am i on", "how long is the traffic jam", "take me home", "")
_SAID_SQL = f"(SELECT conv_id, turn, CASE WHEN (conv_id*7 + turn) % {len(SAYINGS)} = {len(SAYINGS) - 1} THEN text ELSE [{_list(SAYINGS)}][CAST((conv_id*7 + turn) % {len(SAYINGS)} AS INTEGER) + 1] END AS said FROM conversations)"


def sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ((F.col("conv_id") * 7 + F.col("turn")) % len(SAYINGS)).cast("int")
    return talk(spark, sf_dir).select("conv_id", "turn", F.when(k == len(SAYINGS) - 1, F.col("text")).otherwise(F.get(F.array(*map(F.lit, SAYINGS)), k)).alias("said"))


def _java_only(pattern: str) -> str:
    """RE2 has no lookahead: what may follow is spelt out."""
    return pattern.replace("(?! (كيلو|كم))", "($|[^ ]| ($|[^ك])| ك($|[^يم]))")


def _hits(col: str) -> str:
    traffic = f"NOT regexp_matches({col}, {_rx(I.TRAFFIC_WORDS)})"
    return ", ".join(f"CASE WHEN ({' OR '.join(f'regexp_matches({col}, {_rx(_java_only(p))})' for p in ps)}){' AND ' + traffic if n in I.NOT_OF_TRAFFIC else ''} THEN '{n}' END" for n, ps in I.QUESTIONS.items())


_SQUEEZED = "(SELECT *, trim(regexp_replace(lower(said), '\\s+', ' ', 'g')) AS t FROM " + _SAID_SQL + ")"
_INTENT = f"""(SELECT conv_id, turn, CASE WHEN t <> '' AND len(string_split(t, ' ')) <= 9 AND NOT regexp_matches(t, {_rx(I.ACTION_WORDS)}) AND len(h) = 1 THEN h[1] END AS intent
  FROM (SELECT conv_id, turn, t, list_filter([{_hits('t')}], lambda x: x IS NOT NULL) AS h FROM {_SQUEEZED}))"""
_COMMAND = f"(SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(said), {_rx(I.POLITE)}, ' ', 'g'), '\\s+', ' ', 'g')), '[\\s.!?؟،,…]+$', '')) AS t FROM {_SAID_SQL})"


def _words(col: str, most: int) -> str:
    return f"{col} <> '' AND len(string_split({col}, ' ')) <= {most}"


def _either(col: str, patterns: Iterable[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {_rx(p)})" for p in patterns) + ")"


@query("tx_match_intent", f"SELECT conv_id, turn, intent FROM {_INTENT}")
def match_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("conv_id", "turn", I.intent(F.col("said")).alias("intent"))


@query("tx_match_action", f"""
SELECT conv_id, turn, CASE WHEN {_words('t', 5)} AND len(h) = 1 THEN h[1] END AS ack FROM (SELECT conv_id, turn, t, list_filter([{', '.join(f"CASE WHEN {_either('t', ps)} THEN '{n}' END" for n, (_, ps) in I.ACTIONS.items())}], lambda x: x IS NOT NULL) AS h FROM {_COMMAND})""")
def match_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("conv_id", "turn", I.action(F.col("said"))["ack"].alias("ack"))


@query("tx_match_ack", f"SELECT conv_id, turn, CASE WHEN {_words('t', 4)} AND {_either('t', I.THANKS)} THEN 'ack_thanks' END AS ack FROM {_COMMAND}")
def match_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("conv_id", "turn", I.thanks(F.col("said")).alias("ack"))


@query("tx_match_closer", f"SELECT conv_id, turn, CASE WHEN {_words('t', 4)} AND {_either('t', I.CLOSERS)} THEN 'ack_bye' END AS ack FROM {_COMMAND}")
def match_closer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("conv_id", "turn", I.closer(F.col("said")).alias("ack"))


_ALL = sorted({*I.YES, *I.NO, *I.FILLERS}, key=lambda w: (-len(w), w))
_YES_NO = f"""(SELECT conv_id, turn, CASE WHEN {_words('t', 3)} AND trim(regexp_replace(' ' || replace(t, ' ', '  ') || ' ', {_rx('|'.join(f" {w.replace(' ', '  ')} " for w in _ALL))}, ' ', 'g')) = '' THEN
    CASE WHEN y AND NOT n THEN 'yes' WHEN n AND NOT y THEN 'no' END END AS answer
  FROM (SELECT *, regexp_matches(' ' || t || ' ', {_rx(f" (?:{'|'.join(I.YES)}) ")}) AS y, regexp_matches(' ' || t || ' ', {_rx(f" (?:{'|'.join(I.NO)}) ")}) AS n
    FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(said), 'أإآ', 'ااا'), {_rx(I.POLITE)}, ' ', 'g'), '[.!?؟،,…]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM {_SAID_SQL})))"""


@query("tx_match_yes_no", f"SELECT conv_id, turn, answer FROM {_YES_NO}")
def match_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("conv_id", "turn", I.yes_no(F.col("said")).alias("answer"))


@query("cq_rule_cascade", f"""
SELECT i.conv_id, i.turn, CASE WHEN i.turn % 3 = 2 AND answer IS NOT NULL THEN answer WHEN i.turn % 3 <> 2 AND intent IS NOT NULL THEN 'fact' WHEN ack IS NOT NULL THEN 'action' WHEN thanks IS NOT NULL THEN 'thanks' WHEN i.turn % 3 <> 2 AND bye IS NOT NULL THEN 'bye' WHEN length(trim(s.said)) = 0 THEN 'silence' ELSE 'model' END AS branch
FROM {_INTENT} i JOIN {_YES_NO} USING (conv_id, turn) JOIN {_SAID_SQL} s USING (conv_id, turn)
JOIN (SELECT conv_id, turn, CASE WHEN {_words('t', 5)} AND len(list_filter([{', '.join(_either('t', ps) for _, ps in I.ACTIONS.values())}], lambda x: x)) = 1 THEN 1 END AS ack, CASE WHEN {_words('t', 4)} AND {_either('t', I.THANKS)} THEN 1 END AS thanks, CASE WHEN {_words('t', 4)} AND {_either('t', I.CLOSERS)} THEN 1 END AS bye FROM {_COMMAND}) USING (conv_id, turn)""")
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that answers: with an action pending (each third turn) yes and no, without one facts and sign-offs; only the rest go to the model."""
    said, pending = F.col("said"), F.col("turn") % 3 == 2
    answer = I.yes_no(said)
    branch = F.when(pending & answer.isNotNull(), answer).when(~pending & I.intent(said).isNotNull(), "fact").when(I.action(said).isNotNull(), "action").when(I.thanks(said).isNotNull(), "thanks")
    return sayings(spark, sf_dir).select("conv_id", "turn", branch.when(~pending & I.closer(said).isNotNull(), "bye").when(F.trim(said) == "", "silence").otherwise("model").alias("branch"))


_MIN = "CASE WHEN m >= 90 THEN CASE WHEN m//60 = 1 THEN 'an hour' ELSE (m//60) || ' hours' END || CASE WHEN m % 60 BETWEEN 25 AND 35 THEN ' and a half' WHEN m % 60 >= 10 THEN ' and ' || (m % 60) || ' minutes' ELSE '' END WHEN m = 0 THEN 'under a minute' WHEN m = 1 THEN 'a minute' ELSE m || ' minutes' END"
_KM = "CASE WHEN km < 0.975 THEN greatest(50, CAST(round_even(km*20, 0) AS INTEGER)*50) || ' meters' WHEN km < 9.75 THEN CASE WHEN h % 2 = 0 THEN CASE WHEN h = 2 THEN 'a kilometer' ELSE (h//2) || ' kilometers' END WHEN h = 1 THEN 'half a kilometer' WHEN h = 3 THEN 'a kilometer and a half' ELSE (h//2) || ' and a half kilometers' END ELSE CAST(round_even(km, 0) AS INTEGER) || ' kilometers' END"


@query("tx_speak_minutes", f"SELECT event_id, {_MIN} AS said FROM (SELECT event_id, greatest(0, CAST(round_even(value, 0) AS INTEGER)) AS m FROM events)")
def speak_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", I.said_minutes(F.col("value"), F.lit("en")).alias("said"))


@query("tx_speak_distance", f"SELECT event_id, {_KM} AS said FROM (SELECT event_id, value/10 AS km, CAST(round_even(value/5, 0) AS INTEGER) AS h FROM events)")
def speak_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", I.said_distance(F.col("value") / 10, F.lit("en")).alias("said"))


@query("tx_speak_km", "SELECT p_partkey, CASE WHEN km < 0.975 THEN greatest(50, CAST(round_even(km*20, 0) AS INTEGER)*50) || ' m' WHEN km < 9.75 THEN CASE WHEN h % 2 = 0 THEN (h//2) || ' km' ELSE (h//2) || '.5 km' END ELSE CAST(round_even(km, 0) AS INTEGER) || ' km' END AS said FROM (SELECT p_partkey, p_size/4.0::DOUBLE AS km, CAST(round_even(p_size/2.0::DOUBLE, 0) AS INTEGER) AS h FROM part)")
def speak_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distance to read aloud as it stands: metres by fifties, halves of kilometres, then whole ones."""
    km = F.col("p_size") / 4
    half = F.bround(km * 2).cast("int")
    metres = F.concat(F.greatest(F.lit(50), F.bround(km * 20).cast("int") * 50).cast("string"), F.lit(" m"))
    near = F.concat(F.floor(half / 2).cast("string"), F.when(half % 2 == 1, ".5 km").otherwise(" km"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(km < 0.975, metres).when(km < 9.75, near).otherwise(F.concat(F.bround(km).cast("int").cast("string"), F.lit(" km"))).alias("said"))


_CTX = "(SELECT event_id, event_type, value, 60 + 10*(event_id % 5) AS lim, CAST(event_id % 200 AS INTEGER) AS m, value/4 AS km, CAST(round_even(value/2, 0) AS INTEGER) AS h, (17*60 + 40 + event_id % 200) % 1440 AS c FROM events)"
_CLOCK = "(CASE WHEN (c//60) % 12 = 0 THEN 12 ELSE (c//60) % 12 END) || ':' || lpad(CAST(c % 60 AS VARCHAR), 2, '0') || CASE WHEN c//60 < 12 THEN ' am' ELSE ' pm' END"


@query("tx_answer", f"""
SELECT event_id, CASE event_type WHEN 'click' THEN 'The limit here is ' || lim || CASE WHEN value > lim + 3 THEN ' — you''re a bit over it.' ELSE '.' END WHEN 'purchase' THEN 'You''re doing about ' || CAST(round_even(value, 0) AS INTEGER) || ' kilometers per hour.'
  WHEN 'error' THEN 'About ' || {_MIN} || ' to go, arriving around ' || {_CLOCK} || '.' WHEN 'signup' THEN 'About ' || {_KM} || ' to go.' WHEN 'view' THEN 'You''ll arrive around ' || {_CLOCK} || '.' END AS said FROM {_CTX}""")
def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ctx = F.from_json(F.to_json(F.struct(F.col("value").alias("speed_kmh"), (60 + 10 * (F.col("event_id") % 5)).alias("speed_limit_kmh"), (F.col("event_id") % 200).cast("int").alias("eta_min"), (F.col("value") / 4).alias("remaining_km"), F.lit("17:40").alias("local_time"))), I.CONTEXT)
    intent = F.when(F.col("event_type") == "click", "speed_limit").when(F.col("event_type") == "purchase", "current_speed").when(F.col("event_type") == "error", "eta_remaining").when(F.col("event_type") == "signup", "distance_remaining").when(F.col("event_type") == "view", "arrival_time")
    return e.withColumn("ctx", ctx).select("event_id", I.answer(intent, F.col("ctx"), F.lit("en")).alias("said"))


@query("tx_egyptianize")
def egyptianize(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("فاضل "), F.col("p_size").cast("string"), F.lit(" دقيقة، والسرعة "), F.floor("p_retailprice").cast("string"), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", T.egyptianized(line).alias("said"))


@query("tx_masri")
def masri(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("الطريق مزدحم الآن، خد يسارًا بعد "), F.col("p_size").cast("string"), F.lit(" دقيقة على the Ring Road"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")  # a small file has few splits, and lines take their time
    return parts.select("p_partkey", T.masri(line).alias("said"))


_HEARD = "trim(regexp_replace(lower(said), '[\\s.,!?؟،…\"''«»:;-]+', ' ', 'g'))"


@query("tx_phantom", f"SELECT conv_id, turn, t = '' OR regexp_matches(said, {_rx(T.PHANTOMS)}) OR (t IN ({_list(T.SHORT_PHANTOMS)}) AND turn % 10 < 5) OR (len(string_split(t, ' ')) >= 3 AND len(list_distinct(string_split(t, ' '))) = 1) AS phantom FROM (SELECT *, {_HEARD} AS t FROM {_SAID_SQL})")
def phantom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("conv_id", "turn", T.is_phantom(F.col("said"), (F.col("turn") % 10) / 10).alias("phantom"))


@query("tx_neutral", f"SELECT conv_id, turn, t <> '' AND len(list_filter(string_split(t, ' '), lambda w: w NOT IN ({_list(T.INTERJECTIONS)}))) = 0 AS neutral FROM (SELECT *, {_HEARD} AS t FROM {_SAID_SQL})")
def neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sayings(spark, sf_dir).select("conv_id", "turn", T.is_neutral(F.col("said")).alias("neutral"))


@query("agg_jury")
def jury(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words as the English transcript, in Arabic letters as the Arabic one, and both in turn as the third."""
    arabic = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "ابكديفجهيجكلمنوبكرستيفوكيز")
    none = F.lit(None).cast("string")
    witness = lambda text, sure: F.struct(text.alias("text"), sure.alias("confidence"), none.alias("error"))
    n = F.col("conv_id") * 13 + F.col("turn")
    t = talk(spark, sf_dir).withColumns({"ar": witness(arabic, (n % 10) / 10), "en": witness(F.col("text"), (n % 7) / 7), "auto": F.when(n % 5 > 0, witness(F.when(n % 2 == 0, arabic).otherwise(F.col("text")), (n % 3) / 3)), "before": F.when(n % 4 == 0, "ar").when(n % 4 == 1, "en")})
    return T.with_jury(t, "ar", "en", "auto", "before", "v").select("conv_id", "turn", "v.lang", "v.witness", F.round("v.ar_votes", 2).alias("ar_votes"), F.round("v.en_votes", 2).alias("en_votes"))


@query("tx_is_guidance", f"""
WITH l AS (SELECT page_id, (['Turn left onto ', 'In 400 meters, keep right toward ', 'Please tell me about ', 'Heads up — at the roundabout, take the third exit to '])[CAST(page_id % 4 AS INTEGER) + 1] || regexp_extract(url, '://([^/.]*)', 1) || CASE WHEN page_id % 3 = 0 THEN ' Ring Road.' ELSE '.' END AS t FROM pages),
w AS (SELECT *, list_filter(regexp_extract_all(t, '\\d+(?:st|nd|rd|th)?|[A-Za-z]+(?:''[A-Za-z]+)*'), lambda w: NOT regexp_matches(w, '^[0-9]')) AS ws FROM l)
SELECT page_id, regexp_matches(t, {_rx(T.GUIDANCE)}) AND len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]'))) <= 20 AND len(list_filter(ws, lambda w: NOT regexp_matches(w, '^[A-Z]') AND w NOT IN ({_list(T.DIRECTIONS)}))) = 0 AS guidance FROM w""")
def is_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.get(F.array(*map(F.lit, ("Turn left onto ", "In 400 meters, keep right toward ", "Please tell me about ", "Heads up — at the roundabout, take the third exit to "))), (F.col("page_id") % 4).cast("int"))
    line = F.concat(start, F.regexp_extract("url", "://([^/.]*)", 1), F.when(F.col("page_id") % 3 == 0, " Ring Road.").otherwise("."))
    return table(spark, sf_dir, "pages").select("page_id", T.is_guidance(line).alias("guidance"))


@query("tx_scrub", "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' near ' || split_part(p_name, ' ', 1) || 's, call ' || p_name, '(^|[^A-Za-z0-9_])(?:' || p_name || '|' || split_part(p_name, ' ', 1) || ')\\b', '\\1the place', 'g'), '\\s{2,}', ' ', 'g')) AS said FROM part")
def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line without the full name and without its first word, but for words that only begin like it."""
    first = F.split("p_name", " ")[0]
    line = F.concat("p_name", F.lit(" near "), first, F.lit("s, call "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.scrubbed(line, F.array("p_name", first), F.lit("en")).alias("said"))


@query("tx_rating_relevant", f"SELECT p_partkey, kind IS NULL OR {' OR '.join(f'''starts_with(kind, '{r}') OR contains(kind, '{r.rstrip('_')}')''' for r in T.RATED)} AS relevant FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'restaurant' WHEN p_size % 5 = 2 THEN 'mosque' WHEN p_size % 5 = 3 THEN 'meal_takeaway' ELSE lower(p_type) END AS kind FROM part)")
def rating_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    kind = F.when(k == 0, None).when(k == 1, "restaurant").when(k == 2, "mosque").when(k == 3, "meal_takeaway").otherwise(F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.rating_relevant(kind).alias("relevant"))


_SKY = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in T.SKY.items()) + "}"
_WX = "(SELECT event_id, CAST(event_id % 100 AS INTEGER) AS code, CAST(round_even(value/6, 0) AS INTEGER) AS temp, CAST(round_even(value/3, 0) AS INTEGER) AS gust, round_even(value*40/1000, 1) AS vis, CAST(event_id % 90 AS INTEGER) AS pr FROM events)"


@query("src_weather", f"SELECT event_id, coalesce({_SKY}[code], 'unknown') AS conditions, temp AS temp_c, gust AS gusts_kmh, pr AS rain_pct FROM {_WX}")
def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's answer read from its JSON."""
    return _weather(spark, sf_dir).select("event_id", "w.conditions", "w.temp_c", "w.gusts_kmh", "w.rain_pct")


@query("tx_weather_flags", f"""
SELECT event_id, list_filter([CASE WHEN vis < 1 THEN 'low visibility' END, CASE WHEN s IN ('fog', 'freezing fog') THEN 'fog' END, CASE WHEN gust >= 50 THEN 'gusts' END, CASE WHEN contains(s, 'rain') OR contains(s, 'thunder') OR pr >= 60 THEN 'rain' END, CASE WHEN temp >= 40 THEN 'heat' END], lambda x: x IS NOT NULL) AS flags
FROM (SELECT *, coalesce({_SKY}[code], 'unknown') AS s FROM {_WX})""")
def weather_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weather(spark, sf_dir).select("event_id", "w.flags")


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.struct((F.col("event_id") % 100).alias("weather_code"), (F.col("value") / 6).alias("temperature_2m"), (F.col("value") / 3).alias("wind_gusts_10m"), (F.col("value") * 40).alias("visibility")).alias("current"), F.struct(F.array(F.lit(0), (F.col("event_id") % 90).cast("int"), F.lit(0), F.lit(99)).alias("precipitation_probability")).alias("hourly")))
    return e.select("event_id", T.weather(body).alias("w"))


@query("st_retry", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE greatest(0.2::DOUBLE, least(2.5::DOUBLE, floor(value*10)/1000.0::DOUBLE + 0.15::DOUBLE)) END AS wait FROM events")
def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refusal asks to wait, by its own words."""
    body = F.when(F.col("event_type") == "error", "busy").otherwise(F.concat(F.lit("Rate limit. Please try again in "), F.floor(F.col("value") * 10).cast("string"), F.lit("ms.")))
    return table(spark, sf_dir, "events").select("event_id", T.retry_after(body).alias("wait"))


@query("js_sse_parse", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, concat_ws(';', '0:' || string_agg(role, '' ORDER BY turn) FILTER (WHERE turn % 2 = 0), '1:' || string_agg(role, '' ORDER BY turn) FILTER (WHERE turn % 2 = 1)) AS calls FROM conversations GROUP BY conv_id")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a streamed reply: its turns' texts as content, its roles as fragments of two tool calls, read back whole."""
    c = talk(spark, sf_dir)
    call = F.array(F.struct((F.col("turn") % 2).cast("int").alias("index"), F.col("turn").cast("string").alias("id"), F.struct(F.col("role").alias("name"), F.lit("").alias("arguments")).alias("function")))
    chunk = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content"), call.alias("tool_calls")).alias("delta"))).alias("choices")))
    lines = c.select("conv_id", F.col("turn").cast("long").alias("n"), F.concat(F.lit("data: "), chunk).alias("line"))
    done = c.groupBy("conv_id").agg((F.max("turn") + 1).cast("long").alias("n")).select("conv_id", "n", F.lit("data: [DONE]").alias("line"))
    read = T.streamed_reply(lines.union(done), "conv_id", "n", "line")
    first = F.transform("calls", lambda x, i: F.concat(i.cast("string"), F.lit(":"), x["name"]))
    return read.select("conv_id", "text", F.array_join(first, ";").alias("calls"))


def _document(e: DataFrame) -> Column:
    inner = lambda k: F.struct(F.concat(F.lit(f"{k} "), F.col("event_type")).alias("name"), F.col("user_id").alias("rating"), F.array(F.struct(F.col("event_type").alias("name"), F.col("event_id").alias("rating"))).alias("reviews"))
    return F.to_json(F.struct(F.col("event_id").alias("id"), F.array(inner("a"), inner("b")).alias("places"), F.col("user_id").alias("rating"))).alias("d")


@query("prj_strip_keys", "SELECT event_id, '{\"id\":' || event_id || ',\"places\":[{\"name\":\"a ' || event_type || '\"},{\"name\":\"b ' || event_type || '\"}]}' AS kept FROM events")
def strip_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings and reviews are taken out of a document at any depth."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", _document(e)).select("event_id", J.without_keys("d", ("rating", "reviews")).alias("kept"))


@query("js_walk_names", "SELECT event_id, list_sort(list_distinct(['a ' || event_type, 'b ' || event_type, event_type])) AS names FROM events")
def walk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", _document(e)).select("event_id", J.names_in("d", ("name",)).alias("names"))


@query("tx_norm_txt", "SELECT doc_id, sha256(trim(regexp_replace(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'أإآةىـ', 'اااهي'), '[ \t\n\r]+', ' ', 'g'))) AS norm_sha FROM documents")
def norm_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, Arabic letters unified, white space squeezed."""
    t = F.translate(F.translate("text", X.UPPER, X.LOWER), "أإآةىـ", "اااهي")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.trim(F.regexp_replace(t, "[ \t\n\r]+", " ")), 256).alias("norm_sha"))


_JOINED = "(SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"


@query("st_sentence_stream", f"""
SELECT conv_id, len(list_filter(s, lambda x: trim(x) <> '')) - CASE WHEN trim(s[len(s)]) <> '' THEN 1 ELSE 0 END AS sentences, trim(s[len(s)]) AS rest
FROM (SELECT conv_id, regexp_split_to_array(regexp_replace(t, '([.!?؟…\\n])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM {_JOINED})""")
def sentence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as the fragments of one stream: how many sentences have ended, and what is still held back."""
    t = talk(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda v: v["text"]), "").alias("t"))
    parts = F.split("t", r"(?<=[.!?؟…\n])(?=\s)")
    full = F.size(F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != ""))
    return t.select("conv_id", full.cast("long").alias("sentences"), F.trim(F.element_at(parts, -1)).alias("rest"))


@query("cq_inline_voice", """
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?؟…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM conversations),
p AS (SELECT conv_id, turn, unnest(range(len(l))) AS p, length(unnest(l)) AS cost FROM s), c AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn, p) - cost AS used FROM p)
SELECT conv_id, turn, CAST(p AS INTEGER) AS p, cost, used < 400 AS spoken FROM c""")
def inline_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sentence: its cost, and whether the conversation's budget of characters wasn't used up before it."""
    s = talk(spark, sf_dir).select("conv_id", "turn", F.posexplode(X.sentences(F.col("text"))).alias("p", "s")).withColumn("cost", F.char_length("s").cast("long"))
    used = F.sum("cost").over(Window.partitionBy("conv_id").orderBy("turn", "p")) - F.col("cost")
    return s.select("conv_id", "turn", "p", "cost", (used < 400).alias("spoken"))
