"""PII by weak supervision, in DataFrame functions alone.

*Base* spans come from fixed patterns with fixed checks.  *Candidates* come from wider patterns.  Five labelers vote on each candidate
(for, against, or no opinion): its written form, a validity check, a gazetteer, words of the context, and its edges.  Counts of equal vote
patterns, over all documents, go to the driver (they are bounded by the number of patterns); expectation-maximisation estimates there how
reliable each labeler is for each kind and how likely each pattern is personal data.  With these likelihoods as soft labels a logistic span
classifier is trained on votes and shape, and compiled into a column expression.  Candidates that it accepts and that don't overlap a base
span of their kind are added.

The patterns are linear: runs are taken possessively and start only where a run starts, so long runs of digits or letters cost no
backtracking and no stack.

Defined results: a null text counts as empty and has no spans; offsets count code points, the end is exclusive; spans are in order of start, then kind, then
end; a row with a null id is kept; repeated rows are treated alike; without candidates nothing is added; an empty table gives an empty table;
extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masar.llm.shared import materialize, unused

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_L, _D = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Each is the contract's pattern in a form without backtracking: a match starts where its run starts or the last match ended.
BASE = (
    rf"[{_L}](?:(?<![{_L}][{_L}])|(?<=\G[{_L}]))[{_L}]*+@[{_D}]++(?:\.[{_D}]++)++",
    r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_AT, _DOT = r"(?:@| ?[\[({<](?:at|AT)[\])}>] ?| (?:at|AT) )", r"(?:\.| ?[\[({<](?:dot|DOT)[\])}>] ?| (?:dot|DOT) )"
WIDE = (
    rf"[{_L}](?<![{_L}][{_L}])[{_L}]{{0,63}}+{_AT}[{_D}]{{1,63}}+(?:{_DOT}[{_D}]{{1,63}}+){{1,8}}+",
    r"[0-9](?<![0-9A-Za-z.][0-9])[0-9]{0,2}+(?:(?:\.|\[\.\]| \. )[0-9]{1,3}+){3}+(?![0-9A-Za-z])|[0-9A-Fa-f](?<![0-9A-Za-z:][0-9A-Fa-f])[0-9A-Fa-f]{0,3}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Za-z:])",
    r"[0-9](?<![0-9][0-9])(?:[0-9]{3}(?:[ -]?[0-9]{4}){3}|[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\(?(?<![0-9A-Za-z+(]\(?)(?:[0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
)
#: A cheap test that a text can match at all.
TRIGGER = ("@", ".", None, "+")
WIDE_TRIGGER = (r"@|\b(?:at|AT)\b", r"[0-9][.\[: ]", r"[0-9]{3}", r"[0-9]{3}")

# Gazetteers and context words of our own choice.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "be", "us", "ca", "au", "jp", "cn", "in", "br", "ru", "pl", "se", "no", "dk", "fi", "eg", "sa", "ae", "dev", "app", "co", "me", "tv")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|6011|65|64[4-9]|62|35)"
CALLING = r"^(?:1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|96[0-8]|97[0-9])"
CONTEXT_FOR = (r"(?i)(?:e-?mail|mail|contact|write to|correo|courriel|kontakt)\W*$", r"(?i)(?:\bip|host|server|addr\w*|from|login|client)\W*$", r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|pay\w*)\W*$", r"(?i)(?:tel\w*|phone|call|fax|mobile|cell|t[eé]l\w*|dial|ring)\W*$")
CONTEXT_AGAINST = (r"(?i)(?:example|user|login|package|version)\W*$", r"(?i)(?:version|release|\bv|section|chapter|rev\w*|build)\W*$", r"(?i)(?:isbn|order|invoice|tracking|serial|ref\w*|hash|number|no)\W*$", r"(?i)(?:isbn|order|invoice|version|ref\w*|id|page|pp|lot)\W*$")

LABELERS = ("form", "valid", "gazetteer", "context", "edge")
SHAPES = ("length", "digits", "breaks")
_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: within a lambda, an expression is computed again wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def starts_of(lens: Column) -> Column:
    """Sums of what stands before each element; blocks keep the work far below the square of the array's size."""

    def of(own: Column) -> Column:
        last = F.floor((F.size(own) - 1) / _BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(own, b * _BLOCK + 1, F.lit(_BLOCK))), of_blocks)

    def of_blocks(blocks: Column) -> Column:
        return let(F.transform(blocks, _total), lambda sums: F.flatten(F.transform(blocks, lambda block, b: let(_total(F.slice(sums, F.lit(1), b)), lambda base: F.transform(block, lambda _, j: base + _total(F.slice(block, F.lit(1), j)))))))

    return let(lens, lambda own: F.when(F.size(own) > 0, of(own)).otherwise(F.array().cast("array<int>")))


def match_spans(text: Column, pattern: str, may: Column) -> Column:
    """array<struct<s, e, m>> of a pattern's leftmost matches, offsets in code points."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def place(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0)))
            return let(starts_of(steps), lambda starts: F.transform(found, lambda m, i: let(F.get(starts, i) + F.char_length(F.get(gaps, i)), lambda at: F.struct(at.alias("s"), (at + F.char_length(m)).alias("e"), m.alias("m")))))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(none)

    return F.when(may, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def passes(back: Column) -> Column:
        def value(i: Column) -> Column:
            return let(F.ascii(F.substring(back, i, F.lit(1))) - 48, lambda d: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2))

        total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), lambda a, i: a + value(i))
        return (F.length(back) > 0) & (total % 10 == 0)

    return let(F.reverse(digits), passes)


def _octets(m: Column) -> Column:
    """Whether all parts are numbers of at most 255, of any length."""
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the fixed patterns, in order of start, then kind."""
    digit = text.rlike("[0-9][ -]?[0-9]")

    def one(k: int) -> Column:
        may = text.contains(TRIGGER[k]) if TRIGGER[k] else digit
        found = match_spans(text, BASE[k], may)
        if k == IP:
            found = F.filter(found, lambda x: _octets(x["m"]))
        elif k == CARD:
            found = F.filter(found, lambda x: luhn(digits_of(x["m"])))
        elif k == PHONE:
            found = F.filter(found, lambda x: F.length(digits_of(x["m"])).between(9, 15))
        return F.transform(found, lambda x: F.struct(x["s"].alias("start"), F.lit(k).alias("kind"), x["e"].alias("end")))

    return F.array_sort(F.concat(*(one(k) for k in range(4))))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _plain(k: int, m: Column) -> Column:
    """A candidate's written form without disguise; of cards and phones the digits."""
    if k == EMAIL:
        return F.regexp_replace(F.regexp_replace(m, r" ?[\[({<](?:at|AT)[\])}>] ?| (?:at|AT) ", "@"), r" ?[\[({<](?:dot|DOT)[\])}>] ?| (?:dot|DOT) ", ".")
    return F.regexp_replace(F.regexp_replace(m, r"\[\.\]| \. ", "."), ":", ".") if k == IP else digits_of(m)


def _votes(k: int, m: Column, plain: Column, before: Column, left: Column, right: Column) -> list[Column]:
    """What the five labelers say of a candidate of a kind."""
    d = plain
    if k == EMAIL:
        form = _vote(m.rlike(r"^[^@ ]+@[^@ ]+$|[\[({<](?:at|AT)[\])}>]"), ~m.rlike(r"@|[\[({<]at|(?:dot|DOT)"))
        valid = _vote(plain.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?$") & ~plain.contains(".."), F.lit(True))
        gazetteer = _vote(F.lower(F.regexp_extract(plain, r"\.([A-Za-z0-9-]+)$", 1)).isin(*TOP_LEVEL), F.lit(True))
    elif k == IP:
        six = m.contains(":")
        form = _vote(m.rlike(r"^[0-9.]+$") | six | m.contains("["), m.contains(" "))
        valid = _vote(six | (_octets(plain) & ~plain.rlike(r"(?:^|\.)0[0-9]")), F.lit(True))
        gazetteer = _vote(six | F.coalesce(F.regexp_extract(plain, r"^[0-9]+", 0).try_cast("int"), F.lit(0)).between(1, 223), F.lit(True))
    elif k == CARD:
        form = _vote(m.rlike(r"^[0-9]+$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}$"), F.lit(True))
        valid = _vote(luhn(d), F.lit(True))
        gazetteer = _vote(d.rlike(ISSUERS), F.lit(True))
    else:
        form = _vote(m.rlike(r"^\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ -][0-9]{3,4}$|^\+[0-9]{1,3}([ .-])[0-9]{2,4}\1[0-9]{3,4}\1[0-9]{3,4}$|^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$"), m.rlike(r"^[0-9 ]+$"))
        valid = _vote(F.length(d).between(10, 15), F.lit(True))
        gazetteer = _vote(m.startswith("+") & d.rlike(CALLING), m.startswith("+"))
    context = _vote(before.rlike(CONTEXT_FOR[k]), before.rlike(CONTEXT_AGAINST[k]))
    edge = _vote(left.rlike(r"^$|^[\s(\[{<\"':;,>=|]$") & right.rlike(r"^$|^[\s)\]}>\"':;,.!?<|]$"), F.lit(True))
    return [form, valid, gazetteer, context, edge]


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, the LABELERS' votes, the SHAPES>>."""

    def of_kind(k: int) -> Column:
        def one(x: Column) -> Column:
            return let(F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))), lambda before: let(F.substring(text, x["e"] + 1, F.lit(1)), lambda right: let(_plain(k, x["m"]), lambda plain: judged(x, before, right, plain))))

        def judged(x: Column, before: Column, right: Column, plain: Column) -> Column:
            left = F.substring(before, -1, 1)
            n, d = F.char_length(x["m"]), F.length(digits_of(x["m"]))
            breaks = F.char_length(F.regexp_replace(x["m"], "[A-Za-z0-9]", ""))
            shapes = [F.when(n <= 12, 0).when(n <= 20, 1).otherwise(2), F.when(d <= 9, 0).when(d <= 12, 1).otherwise(2), F.when(breaks <= 1, 0).when(breaks <= 3, 1).otherwise(2)]
            votes = _votes(k, x["m"], plain, before, left, right)
            return F.struct(x["s"].alias("start"), F.lit(k).alias("kind"), x["e"].alias("end"), *(v.alias(n) for n, v in zip((*LABELERS, *SHAPES), [*votes, *shapes], strict=True)))

        return F.transform(match_spans(text, WIDE[k], text.rlike(WIDE_TRIGGER[k])), one)

    return F.concat(*(of_kind(k) for k in range(4)))


@dataclass(frozen=True)
class Reliability:
    """For each kind: the share of personal data, and P(vote | class) of each labeler as [labeler][class][vote + 1]."""

    prior: tuple[float, ...]
    tables: tuple[np.ndarray, ...]

    def posterior(self, kind: int, votes: np.ndarray) -> np.ndarray:
        log = np.log([1 - self.prior[kind], self.prior[kind]])[None, :] + sum(np.log(self.tables[kind][j][:, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


#: A check that fails rules personal data out, so P(valid = -1 | personal) is given and not estimated.
VALID = LABELERS.index("valid")
IMPOSSIBLE = 1e-6


def expectation_maximisation(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, steps: int = 100) -> Reliability:
    """Estimates from counted vote patterns; starts from the majority of the votes, so that class 1 is personal data."""
    priors, tables = [], []
    for k in range(4):
        own = kinds == k
        v, n = votes[own], counts[own].astype(float)
        q = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))
        prior, table = 0.5, np.full((v.shape[1], 2, 3), 1 / 3)
        for _ in range(steps if len(v) else 0):
            prior = float((n @ q + 1) / (n.sum() + 2))
            for j in range(v.shape[1]):
                for c, weight in enumerate((n * (1 - q), n * q)):
                    # one pseudo-count for each vote, and two for the belief that a labeler is right more often than not
                    mass = np.bincount(v[:, j] + 1, weight, 3) + 1 + np.array([2.0, 0, 0] if c == 0 else [0, 0, 2.0])
                    table[j, c] = mass / mass.sum()
            table[VALID, 1, 0] = IMPOSSIBLE
            new = Reliability((prior,) * 4, (table,) * 4).posterior(0, v)
            if np.abs(new - q).max() < 1e-9:
                break
            q = new
        priors.append(prior)
        tables.append(table.copy())
    return Reliability(tuple(priors), tuple(tables))


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights: an intercept for each kind, and a weight for each (kind, feature, value)."""

    intercepts: tuple[float, ...]
    weights: dict[tuple[int, int, int], float]

    def accepts(self, c: Column) -> Column:
        names = (*LABELERS, *SHAPES)
        chosen = F.lit(False)
        for k, b in enumerate(self.intercepts):
            z = F.lit(b)
            for (kind, j, value), w in self.weights.items():
                if kind == k and w and (j, value) != (VALID, -1):
                    z = z + F.when(c[names[j]] == value, w).otherwise(0.0)
            chosen = F.when(c["kind"] == k, z >= 0).otherwise(chosen)
        return chosen & (c[names[VALID]] >= 0)


def train_classifier(kinds: np.ndarray, features: np.ndarray, counts: np.ndarray, soft: np.ndarray, ridge: float = 1.0) -> SpanClassifier:
    """Newton steps on soft labels, for each kind apart."""
    intercepts, weights = [], {}
    for k in range(4):
        own = kinds == k
        f, n, y = features[own], counts[own].astype(float), soft[own]
        if not len(f):
            intercepts.append(-1.0)
            continue
        terms = sorted({(j, int(v)) for j in range(f.shape[1]) for v in np.unique(f[:, j])})
        x = np.column_stack([np.ones(len(f)), *((f[:, j] == v).astype(float) for j, v in terms)])
        w, penalty = np.zeros(x.shape[1]), np.diag([1e-3] + [ridge] * len(terms))
        n = n / max(1.0, n.sum() / 1e5)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (n * (p - y)) + penalty @ w)
            w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        intercepts.append(float(w[0]))
        weights |= {(k, j, v): float(c) for (j, v), c in zip(terms, w[1:], strict=True)}
    return SpanClassifier(tuple(intercepts), weights)


def learn(found: DataFrame, column: str) -> tuple[SpanClassifier, Reliability]:
    """From counts of equal (kind, votes, shapes): 4 * 3**8 rows at most, and far fewer in practice."""
    names = ["kind", *LABELERS, *SHAPES]
    rows = found.select(F.explode(column).alias("c")).groupBy(*(F.col(f"c.{n}").alias(n) for n in names)).agg(F.count("*").alias("n")).collect()
    rows = sorted(rows)
    table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(names) + 1)
    kinds, features, counts = table[:, 0], table[:, 1:-1], table[:, -1]
    votes = features[:, : len(LABELERS)]
    reliability = expectation_maximisation(kinds, votes, counts)
    soft = np.zeros(len(table))
    for k in range(4):
        own = kinds == k
        soft[own] = reliability.posterior(k, votes[own])
    return train_classifier(kinds, features, counts, soft), reliability


def detect(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), base: str = "base", spans: str = "spans") -> DataFrame:
    """The ``keep`` columns, ``base`` and ``spans``: arrays of struct<start, kind, end>, kind as a place in KINDS."""
    whole, sure, wide = F.coalesce(F.col(f"`{text}`"), F.lit("")), unused(docs, "sure_spans"), unused(docs, "wide_spans")
    found = materialize(docs.select(*(F.col(f"`{c}`") for c in keep), base_spans(whole).alias(sure), candidates(whole).alias(wide)), "pii")
    classifier, _ = learn(found, wide)
    free = lambda c: ~F.exists(sure, lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.transform(F.filter(wide, lambda c: classifier.accepts(c) & free(c)), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.select(*(F.col(f"`{c}`") for c in keep), F.col(sure).alias(base), F.array_sort(F.concat(sure, added)).alias(spans))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: reduce(lambda rest, i: F.when(k == i, KINDS[i]).otherwise(rest), range(3), F.lit(KINDS[3]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the upper-case kind of its first in angle brackets."""
    zero = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def join(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        overlap = (F.size(done) > 0) & (F.coalesce(last["end"], F.lit(-1)) > x["start"])
        grown = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(overlap, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    def tag(kind: Column) -> Column:
        return reduce(lambda rest, i: F.when(kind == i, f"<{KINDS[i].upper()}>").otherwise(rest), range(3), F.lit(f"<{KINDS[3].upper()}>"))

    def cut(merged: Column) -> Column:
        return let(F.concat(F.array(F.lit(0)), F.transform(merged, lambda x: x["end"])), lambda ends: rebuilt(merged, ends))

    def rebuilt(merged: Column, ends: Column) -> Column:
        pieces = F.transform(merged, lambda x, i: F.concat(F.substring(text, F.get(ends, i) + 1, x["start"] - F.get(ends, i)), tag(x["kind"])))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text)))

    merged = F.aggregate(spans, zero, lambda done, x: F.when(F.size(done) == 0, F.array(x)).otherwise(join(done, x)))
    return F.when(F.size(spans) > 0, let(merged, cut)).otherwise(text)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    sure, all_ = (unused(docs, n) for n in ("base", "spans"))
    found = detect(docs, text, (key,), sure, all_)

    def count(k: int) -> Column:
        return F.size(F.filter(sure, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(4)]
    return found.select(F.col(f"`{key}`"), *counts, F.sha2(listed(F.col(sure)), 256).alias("base_sha256"), listed(F.col(all_)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all personal data in their texts replaced by the kind in angle brackets; all columns stay."""
    sure, all_ = (unused(docs, n) for n in ("base", "spans"))
    found = detect(docs, text, docs.columns, sure, all_)
    return found.select(*(F.when(F.size(all_) > 0, redact(F.col(f"`{c}`"), F.col(all_))).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
