"""URL filters: longest host and path rules, then a weighted vocabulary.

``judge`` parts each url into host and path.  The longest rule that fits decides; where none fits, an Aho-Corasick
automaton over the lower-cased url counts vocabulary terms.  A *strict* term counts only with a boundary (an end of the
url or a character other than a-z and 0-9) on both sides, and one such hit rejects.  A *soft* term of ``SHORT`` letters or more needs a
boundary on one side at least, a shorter one on both; distinct soft terms whose weights add up to ``limit`` or more reject.  Every soft weight is less than
the limit, so it takes several; a term hit again counts once, and a term that lies within another term's hit counts only by its own boundaries.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is judged by its terms alone
(null: allowed); repeated rows are judged alike; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract, and a vocabulary of our own: categories that public blocklists reject (adult, gambling, pills, piracy, malware, link farms, advertising).
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
STRICT = (
    "adult", "xxx", "porn", "porno", "pornos", "hentai", "milf", "bdsm", "camgirl", "camgirls", "sexcam", "sexcams", "escort", "escorts", "erotica", "fetish", "hardcore", "onlyfans",
    "warez", "keygen", "keygens", "torrent", "torrents", "nulled", "crackz", "serialz", "phishing", "malware", "ransomware", "botnet", "spyware", "spamfarm", "linkfarm", "doorway",
)
SOFT = {
    "ads": 1, "adserver": 1.5, "affiliate": 1, "banner": 1, "bets": 1, "betting": 1.5, "bingo": 1, "bitcoin": 1, "blackjack": 1.5, "bonus": 1, "buy": 1, "cash": 1, "casino": 1.5, "cheap": 1, "cialis": 1.5, "clicks": 1, "coupon": 1, "crack": 1,
    "credit": 1, "crypto": 1, "dating": 1, "deals": 1, "diet": 1, "discount": 1, "download": 1, "drugs": 1, "farm": 1, "forex": 1, "free": 1, "gambling": 1.5, "girls": 1, "hacks": 1, "hot": 1, "jackpot": 1.5, "kasino": 1.5, "keto": 1, "levitra": 1.5,
    "loan": 1, "loans": 1, "lottery": 1.5, "lotto": 1, "meds": 1, "money": 1, "naked": 1.5, "nude": 1.5, "online": 1, "payday": 1, "pharmacy": 1, "pills": 1.5, "poker": 1.5, "popup": 1, "promo": 1, "replica": 1, "roulette": 1.5, "sale": 1, "serial": 1,
    "sex": 1.5, "sexy": 1.5, "shemale": 1.5, "singles": 1, "slot": 1, "slots": 1.5, "spam": 1.5, "sportsbook": 1.5, "steroids": 1.5, "streams": 1, "swinger": 1.5, "track": 1, "tracker": 1, "traffic": 1, "tramadol": 1.5, "viagra": 1.5, "vip": 1, "watches": 1,
    "webcam": 1, "weightloss": 1.5, "wett": 1, "win": 1, "xanax": 1.5,
}
LIMIT = 2
#: Soft terms of fewer letters need a boundary on both sides, as they stand inside too many other words.
SHORT = 6


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for null or without ``://``."""
    ascii_lower = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_lower, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the url's host or a parent of it and whose path starts the url's path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, rule).otherwise(out)
    return out


def _edge(text: str, at: int) -> bool:
    return at < 0 or at >= len(text) or not (text[at].isascii() and text[at].isalnum())


def term_hits(url: str, automaton: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms of a lower-cased url."""
    strict, soft = set(), set()
    for end, (term, weight) in automaton.iter(url):
        before, after = _edge(url, end - len(term)), _edge(url, end + 1)
        if weight is None and before and after:
            strict.add(term)
        elif weight is not None and (before and after if len(term) < SHORT else before or after):
            soft.add(term)
    return strict, soft


def automaton_of(strict: tuple[str, ...], soft: dict[str, float]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in strict:
        out.add_word(term, (term, None))
    for term, weight in soft.items():
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


_LOWER = {i: i + 32 for i in range(65, 91)}


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: dict[str, str] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, float] = SOFT, limit: float = LIMIT) -> DataFrame:
    """key, host, path, rule, verdict, strict_hits (array), soft_hits (array), soft_weight."""
    if twice := set(strict) & set(soft):
        raise ValueError(f"strict and soft at once: {sorted(twice)}")
    if heavy := [t for t, w in soft.items() if not 0 < w < limit]:
        raise ValueError(f"one soft term alone must not reject: {heavy}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(strict, soft)
        for batch in batches:
            found = [term_hits((u or "").translate(_LOWER), automaton) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "host", "path", "rule")), pa.array([sorted(s) for s, _ in found], pa.list_(pa.string())), pa.array([sorted(s) for _, s in found], pa.list_(pa.string())), pa.array([sum(soft[t] for t in s) for _, s in found], pa.float64())],
                names=["key", "host", "path", "rule", "strict_hits", "soft_hits", "soft_weight"],
            )

    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    kind = pages.schema[key].dataType.simpleString()
    hits = rows.mapInArrow(count, f"key {kind}, host string, path string, rule string, strict_hits array<string>, soft_hits array<string>, soft_weight double")
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    by_terms = F.when((F.size("strict_hits") > 0) | (F.col("soft_weight") >= limit), "block").otherwise("allow")
    return hits.withColumn("verdict", F.coalesce(by_rule, by_terms)).select(F.col("key").alias(key), "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")


def oracle() -> str:
    """DuckDB SQL for the query on ``pages``."""
    edge, low = "[^a-z0-9]", "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = []
    for rule in sorted(RULES, key=lambda r: (-len(r), r)):
        name, _, start = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{rule}'")
    hard = " OR ".join(f"regexp_matches(u, '(^|{edge}){t}({edge}|$)')" for t in STRICT)
    either, both = (lambda t: f"(^|{edge}){t}|{t}({edge}|$)"), (lambda t: f"(^|{edge}){t}({edge}|$)")
    weight = " + ".join(f"CASE WHEN regexp_matches(u, '{(both if len(t) < SHORT else either)(t)}') THEN {w} ELSE 0 END" for t, w in SOFT.items())
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    return f"""
WITH cut AS (
  SELECT page_id, {low} AS u, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM pages),
parts AS (
  SELECT page_id, u,
         CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(u, p + 3), '^([^/?#]*)', 1) END AS host,
         CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(url, p + 3), '^[^/?#]*(/[^?#]*)', 1) END AS path FROM cut),
ruled AS (SELECT *, CASE {' '.join(fits)} ELSE NULL END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE rule {verdict} ELSE CASE WHEN {hard} OR {weight} >= {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled"""
