"""Text as column expressions: a closed normaliser for Latin and Arabic, tokens, stems, scripts, phrases."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the normaliser folds. Each character of the first string becomes the one below it.
LATIN_FROM = "áàâäãåāçćčéèêëēęíìîïīıñńóòôöõōøśšşúùûüūýÿźżžğÁÀÂÄÃÅĀÇÉÈÊËÍÎÏİÑÓÔÖØŞŠÚÛÜÝŽĞ"
LATIN_TO = "aaaaaaaccceeeeeeiiiiiinnooooooosssuuuuuyyzzzgaaaaaaaceeeeiiiinoooossuuuyzg"
ARABIC_FROM = "أإآٱٲٳىئیېۍةۀہھؤگکڤڨپچ"
ARABIC_TO = "اااااايييييههههوككففبج"
ARABIC_DROP = "ء"
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = "[ً-ٰٟۖ-ۭـ]"
WORD = "a-z0-9ء-غف-يٱ-ۓß-öø-ɏͰ-ϿЀ-ӿ"
ARABIC = "ء-يٱ-ۓ"
PREFIXES = ("وال", "بال", "فال", "كال", "لل", "ال")
ARTICLES = ("el", "al")
NOT_ARTICLES = ("alex", "alexandria")
MIN_STEM = 3
LATIN_STOP = ("el", "al", "the", "of", "and", "de", "la", "le", "les", "du", "des", "for", "in", "at", "&")
ARABIC_STOP = ("و", "في", "فى", "من", "على", "علي", "عند", "ال")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(text: Column) -> Column:
    """Case and accents folded, marks dropped, letters unified, digits to ASCII, other characters to single spaces."""
    s = F.translate(F.coalesce(text, F.lit("")), UPPER + LATIN_FROM, LOWER + LATIN_TO)
    s = F.replace(s, F.lit("ß"), F.lit("ss"))
    s = F.regexp_replace(s, MARKS, "")
    s = F.translate(s, ARABIC_FROM + DIGITS_FROM + ARABIC_DROP, ARABIC_TO + DIGITS_TO)
    s = F.regexp_replace(s, f"[^{WORD}]+", " ")
    s = F.regexp_replace(s, f"(?<=[{ARABIC}])(?=[0-9])|(?<=[0-9])(?=[{ARABIC}])", " ")
    return F.trim(s)


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " +"), lambda t: t != "")


def stem(token: Column) -> Column:
    """The token without its longest attached prefix or its article, where enough of it is left; else null."""
    arabic = token.rlike(f"[{ARABIC}]")
    out = F.lit(None).cast("string")
    for a in reversed(ARTICLES):
        out = F.when(~arabic & token.startswith(a) & (F.length(token) > 4) & ~token.isin(*NOT_ARTICLES), F.substring(token, len(a) + 1, 1_000_000_000)).otherwise(out)
    for p in reversed(PREFIXES):
        out = F.when(arabic & token.startswith(p) & (F.length(token) - len(p) >= MIN_STEM), F.substring(token, len(p) + 1, 1_000_000_000)).otherwise(out)
    return out


def is_stop(token: Column) -> Column:
    return token.isin(*LATIN_STOP, *ARABIC_STOP)


def script_counts(text: Column) -> tuple[Column, Column]:
    """How many Arabic and how many ASCII letters."""
    return F.regexp_count(text, F.lit(f"[{ARABIC}]")), F.regexp_count(text, F.lit("[A-Za-z]"))


def script_of(arabic: Column, latin: Column, share: float = 0.8) -> Column:
    total = arabic + latin
    return F.when(total == 0, "neutral").when(arabic / total > share, "ar").when(latin / total > share, "latin").otherwise("mixed")


def loose(token: Column) -> Column:
    """Without weak letters after the first, doubled letters once."""
    base = F.coalesce(stem(token), token)
    drop = F.when(base.rlike(f"[{ARABIC}]"), F.regexp_replace(F.substring(base, 2, 1_000_000_000), "[اويهى]", "")).otherwise(F.regexp_replace(F.substring(base, 2, 1_000_000_000), "[aeiouyhw]", ""))
    return F.regexp_replace(F.concat(F.substring(base, 1, 1), drop), r"(.)\1+", "$1")


def max_edits(token: Column) -> Column:
    n = F.length(token)
    return F.when(token.rlike(f"[{ARABIC}]"), F.when(n < 3, 0).when(n < 7, 1).otherwise(2)).otherwise(F.when(n < 4, 0).when(n < 8, 1).otherwise(2))


def clean_controls(text: Column, limit: int) -> Column:
    """Without bidirectional and zero-width controls, trimmed and cut."""
    return F.substring(F.trim(F.regexp_replace(text, "[​-‏‪-‮⁠-⁩﻿\u0000-\u001f]", "")), 1, limit)


def sentences(text: Column) -> Column:
    """Parts that end in a mark followed by white space; a decimal point ends none."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?؟…])\s+"), F.trim), lambda s: s != "")


def short_name(text: Column, most: int = 30) -> Column:
    """The first comma part, cut with an ellipsis."""
    first = F.trim(F.split(text, ",")[0])
    return F.when(F.char_length(first) > most, F.concat(F.substring(first, 1, most - 1), F.lit("…"))).otherwise(first)


def six_digits(x: Column) -> Column:
    """Six decimals without trailing zeros; minus zero is zero."""
    s = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""), r"\.$", "")
    return F.when(s == "-0", "0").otherwise(s)


def first_of(*parts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(p, F.lit("")) for p in parts))


def count_of(rules: dict[str, str], text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in rules.items()}
