"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are the matches of strict patterns (email, ip, card, phone), those of them that fail their check,
and matches of looser patterns: spelled-out email addresses, IPv6 addresses, phone numbers without a calling code. Five
labelers vote for or against each candidate, or abstain: its form (strict pattern and check), its shape, a gazetteer
(top-level domains, reserved networks, card issuers, calling and area codes), cue words before it, and the characters it touches.

Expectation-maximisation over the counts of vote patterns estimates how reliable every labeler is for each kind, and
from that how likely each candidate is personal data. These soft labels train the span classifier, a logistic scorer over
the candidate's form, surroundings, length, digits, separators and cue. Patterns and features have few values
each, so what comes to the driver are counts of at most some ten thousand combinations, whatever the number of documents.

Strict matches that pass their check are always spans. Loose ones become spans if the classifier gives them ``threshold`` or
more, they overlap no strict span, and no accepted candidate before them reaches into them. Matches that fail their check are
only learned from.

Spans are in code points, end exclusive. Patterns look back for the start of a run and take runs as a whole, so
that long runs are read once; the matches are the plain patterns' (tests compare). A candidate's surroundings end at the
neighbouring match of the same pattern.

Defined results: null text is empty and has no spans; repeated rows are reported each time and count each time in learning;
without loose candidates the classifier adds nothing; an empty table gives no rows; null ids are reported like any other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.frames import text_or_empty
from lectern.plans.sizing import staged

THRESHOLD = 0.5
CONTEXT = 40  # characters before a candidate in which cues are looked for
FOR, AGAINST, ABSTAIN = 1, 2, 0
LABELERS = ("form", "shape", "gazetteer", "context", "edges")
ROUNDS, STEPS, PENALTY = 200, 400, 1e-3

# The kinds in the order in which spans are listed, and what their strict matches look like.
KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Source:
    """A pattern of candidates, and a cheaper test that every text with a match passes."""

    kind: str
    pattern: str
    strict: bool
    needs: str


SOURCES = (
    Source("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, "@"),
    Source("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, r"[0-9]\.[0-9]"),
    Source("card", r"[0-9](?:[\x20-]?[0-9])++", True, r"[0-9][\x20-]?[0-9]"),
    Source("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, r"\+[0-9]"),
    Source("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]++"
                    r"(?:(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?)[A-Za-z0-9-]++)++", False, r"[\[({]\x20?(?i:at)\x20?[\])}]"),
    Source("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", False, "[0-9A-Fa-f]:[0-9A-Fa-f]"),
    Source("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", False,
           r"[0-9]{3}[\x20.-][0-9]{4}"),
)

# Gazetteers and cues, all lower case.
DOMAINS = ("com", "org", "net", "edu", "gov", "int", "mil", "info", "biz", "name", "io", "co", "ai", "app", "dev", "eu", "us", "uk",
           "de", "at", "ch", "fr", "be", "es", "mx", "ar", "it", "nl", "pl", "pt", "br", "ca", "au", "in", "jp", "cn", "ru")
RESERVED = r"^0*(?:0|10|127|22[4-9]|2[34][0-9]|25[0-5])\.|^0*192\.0*168\.|^0*169\.0*254\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\."
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9])"
CODES = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|67[0-9]|69[0-2]|8[058][0-9]|9[679][0-9])"
CUES = {
    "email": "mail|e-mail|email|contact|write|kontakt|courriel|correo",
    "ip": "ip|ipv4|ipv6|address|host|server|adresse|dirección",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono",
}
COUNTER_CUES = "version|release|section|chapter|isbn|issn|order|invoice|article|page|figure|part"


# --- candidates --------------------------------------------------------------

def _matches(source: Source, text: Column) -> Column:
    """Of each match: length of the piece before it, the match, what stands before and after; empty if there is none."""
    whole = F.regexp_extract_all(text, F.lit(source.pattern), F.lit(0))
    pieces = F.split(text, source.pattern, -1)
    n = F.size(whole)
    zipped = F.arrays_zip(
        F.slice(pieces, F.lit(1), n).alias("gap"), whole.alias("whole"), F.slice(pieces, F.lit(2), n).alias("next"))
    found = F.transform(zipped, lambda z: F.struct(
        F.length(z["gap"]).alias("before"), z["whole"].alias("whole"),
        F.substring(z["gap"], -CONTEXT, CONTEXT).alias("left"), F.substring(z["next"], 1, 1).alias("right")))
    kind = "array<struct<before: int, whole: string, left: string, right: string>>"
    needed = F.contains(text, F.lit("@")) if source.needs == "@" else text.rlike(source.needs)
    return F.when(needed & text.rlike(source.pattern), found.cast(kind)).otherwise(F.array().cast(kind))


def _by_kind(of: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for kind, value in of.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def _valid(whole: Column, digits: Column) -> Column:
    """Whether a match of the strict pattern passes its kind's check."""

    def number(part: Column) -> Column:
        return F.regexp_replace(part, "^0+", "")

    parts = F.forall(F.split(whole, r"\."), lambda p: (F.length(number(p)) < 3) | ((F.length(number(p)) == 3) & (number(p) <= "255")))
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    luhn = F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0
    n = F.length(digits)
    return _by_kind({"ip": parts, "card": F.when(n.between(13, 19), luhn).otherwise(False), "phone": n.between(9, 15)}, F.lit(True))


def _vote(agrees: Column, objects: Column) -> Column:
    return F.when(objects, AGAINST).when(agrees, FOR).otherwise(ABSTAIN)


def _votes(whole: Column, digits: Column, left: Column, right: Column) -> list[Column]:
    """Votes of all labelers, in their order."""
    loose = ~F.col("strict")
    form = F.when(loose, ABSTAIN).when(F.col("valid"), FOR).otherwise(AGAINST)
    shape = _by_kind({
        "email": _vote(whole.rlike(r"^[A-Za-z0-9][^@]{0,62}[A-Za-z0-9]@"), whole.rlike(r"^[.]|[.]@|@-|-[.]|-$|[.][.]")),
        "ip": _vote(~whole.rlike(r"(?:^|\.)0[0-9]"), F.lit(False)),
        "card": _vote(whole.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), F.length(digits) < 13),
        "phone": _vote(whole.rlike(r"[0-9]{2,4}[\x20).-]{1,2}[0-9]{2,4}[\x20.-][0-9]{2,4}$"),
                       F.regexp_count(whole, F.lit(r"\(")) != F.regexp_count(whole, F.lit(r"\)"))),
    }, F.lit(ABSTAIN))
    domain = F.lower(F.regexp_extract(whole, "([A-Za-z0-9-]+)$", 1))
    area = loose & digits.rlike("^[2-9]")
    gazetteer = _by_kind({
        "email": _vote(domain.isin(*DOMAINS), domain.rlike("^[0-9-]+$")),
        "ip": F.when(loose, _vote(whole.rlike("^[23]"), whole.rlike("^(?i:fe80|f[cd]|0)"))).otherwise(_vote(F.lit(True), whole.rlike(RESERVED))),
        "card": _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": _vote(area | (~loose & digits.rlike(CODES)), F.lit(False)),
    }, F.lit(ABSTAIN))
    context = F.when(F.col("cue") == "for", FOR).when(F.col("cue") == "against", AGAINST).otherwise(ABSTAIN)
    glued = left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]")
    return [form, shape, gazetteer, context, F.when(glued, AGAINST).otherwise(FOR)]


def _cue(left: Column) -> Column:
    """Whether a word before the candidate speaks for its kind, or against any."""
    before = F.lower(left)

    def says(words: str) -> Column:
        return before.rlike(rf"(?:^|[^\p{{L}}])(?:{words})(?:[^\p{{L}}]|$)")

    return F.when(_by_kind({k: says(words) for k, words in CUES.items()}, F.lit(False)), "for").when(
        says(COUNTER_CUES), "against").otherwise("none")


def _touching(char: Column) -> Column:
    return (F.when(char == "", "edge").when(char.rlike(r"\s"), "space").when(char.rlike(r"[\p{L}\p{N}_]"), "word").otherwise("mark"))


def _features(whole: Column, digits: Column, left: Column, right: Column) -> list[Column]:
    """Names and values of what the classifier looks at."""
    marks = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(whole, F.lit(r"[\x20().\[\]:@-]"), F.lit(0)))), "")
    kind_of_marks = (F.when(marks == "", "none").when(marks == " ", "spaces").when(marks == "-", "dashes").when(marks == ".", "dots")
                     .when(marks.contains("("), "round").when(marks.contains("["), "square").when(marks.contains("@"), "at").otherwise("mixed"))
    values = {
        "form": F.when(~F.col("strict"), "loose").when(F.col("valid"), "strict").otherwise("failed"),
        "before": _touching(F.substring(left, -1, 1)), "after": _touching(right),
        "length": F.least(F.floor(F.length(whole) / 6), F.lit(5)).cast("string"),
        "digits": F.least(F.floor(F.length(digits) / 4), F.lit(5)).cast("string"),
        "marks": kind_of_marks, "cue": F.col("cue"),
    }
    return [F.concat_ws("=", F.lit(name), value) for name, value in values.items()]


def candidates(docs: DataFrame, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((row, path) of every row of ``docs``, its candidates): one scan of the texts, written to the shared folder."""
    whole_text = text_or_empty(text)
    each = F.array(*[F.struct(F.lit(i).alias("source"), _matches(s, whole_text).alias("matches")) for i, s in enumerate(SOURCES)])
    found = staged(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(path).alias("path"),
        F.filter(each, lambda s: F.size(s["matches"]) > 0).alias("found")), "pii")
    spread = found.select("row", F.inline("found")).select("row", "source", F.posexplode("matches").alias("at", "m"))
    so_far = W.partitionBy("row", "source").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    whole, left, right = F.col("m.whole"), F.col("m.left"), F.col("m.right")
    digits = F.col("digits")
    kinds = F.array(*[F.lit(s.kind) for s in SOURCES])
    strict = F.array(*[F.lit(s.strict) for s in SOURCES])
    placed = (
        spread.withColumn("until", F.sum(F.col("m.before") + F.length(whole)).over(so_far).cast("int"))
        .withColumns({
            "kind": F.element_at(kinds, F.col("source") + 1), "strict": F.element_at(strict, F.col("source") + 1),
            "begin": F.col("until") - F.length(whole), "digits": F.regexp_replace(whole, "[^0-9]", "")})
        .where((F.col("kind") != "card") | F.length(digits).between(13, 19))  # other numbers are no candidates
        .withColumn("valid", F.col("strict") & _valid(whole, digits))
        .withColumn("cue", _cue(left))
    )
    votes = [v * 3**i for i, v in enumerate(_votes(whole, digits, left, right))]
    return found.select("row", "path"), staged(placed.select(
        "row", "kind", "begin", "until", "strict", "valid", sum(votes[1:], votes[0]).cast("int").alias("votes"),
        F.array(*_features(whole, digits, left, right)).alias("features")), "candidates")


# --- learning ----------------------------------------------------------------

def cast(patterns: np.ndarray) -> np.ndarray:
    """Votes of all labelers, a row for each pattern."""
    return np.asarray(patterns)[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Probability of personal data for each vote pattern, by expectation-maximisation over their counts.

    Begins with any vote against outweighing those for, a valid form excepted. Every labeler starts from a few made-up votes
    in favour of its being right, which keep the classes from changing places.
    """
    votes, n = cast(patterns), np.asarray(counts, float)
    doubted = (votes == AGAINST).any(axis=1)
    likely = np.where(~doubted, 0.9, np.where(votes[:, 0] == FOR, 0.5, 0.1))
    for _ in range(rounds):
        share = np.array([(n * (1 - likely)).sum() + 1, (n * likely).sum() + 1])
        odds = np.log(share[1]) - np.log(share[0]) + np.zeros(len(n))
        for i in range(votes.shape[1]):
            rate = np.array([[1.0, 0.5, 2.0], [1.0, 2.0, 0.5]])  # class (other, personal) by vote
            for c, weight in enumerate((n * (1 - likely), n * likely)):
                rate[c] += np.bincount(votes[:, i], weight, 3)
            rate /= rate.sum(axis=1, keepdims=True)
            odds += np.log(rate[1, votes[:, i]]) - np.log(rate[0, votes[:, i]])
        before, likely = likely, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(likely - before).max(initial=0.0) < 1e-9:
            break
    return likely


def fitted(rows: Sequence[tuple[Sequence[str], float, int]], steps: int = STEPS, penalty: float = PENALTY) -> dict[str, float]:
    """Weights of a logistic scorer from (features, probability, count) rows; accelerated gradient steps."""
    names = sorted({f for features, _, _ in rows for f in features})
    place = {f: i for i, f in enumerate(names)}
    at = np.array([[place[f] for f in features] for features, _, _ in rows])
    target, n = np.array([p for _, p, _ in rows]), np.array([c for _, _, c in rows], float)
    n /= n.sum()
    w = ahead = np.zeros(len(names))
    pace, rate = 1.0, 1 / (0.25 * at.shape[1] + penalty)
    for _ in range(steps):
        miss = n * (1 / (1 + np.exp(-ahead[at].sum(axis=1))) - target)
        gradient = np.bincount(at.ravel(), np.repeat(miss, at.shape[1]), len(names)) + penalty * ahead
        step = ahead - rate * gradient
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, w, pace = step + (pace - 1) / next_pace * (step - w), step, next_pace
    return dict(zip(names, w.tolist()))


def learned(counts: Sequence[tuple[str, int, Sequence[str], int]]) -> dict[str, dict[str, float]]:
    """Classifier weights by kind from (kind, votes, features, count) rows, for kinds that have candidates."""
    out = {}
    for kind in KINDS:
        rows = sorted((v, tuple(f), n) for k, v, f, n in counts if k == kind)
        if rows:
            patterns = sorted({v for v, _, _ in rows})
            likely = estimated(np.array(patterns), np.array([sum(n for v, _, n in rows if v == p) for p in patterns]))
            by_pattern = dict(zip(patterns, likely.tolist()))
            out[kind] = fitted([(f, by_pattern[v], n) for v, f, n in rows])
    return out


def learn(found: DataFrame) -> dict[str, dict[str, float]]:
    """Label model and classifier of a table of candidates."""
    grouped = found.groupBy("kind", "votes", "features").count().collect()
    return learned([(r.kind, r.votes, r.features, r["count"]) for r in grouped])


# --- spans -------------------------------------------------------------------

def probability(weights: dict[str, dict[str, float]]) -> Column:
    """The classifier's probability of a row of candidates; null for kinds it hasn't seen."""

    def of_kind(of: dict[str, float]) -> Column:
        table = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
        score = F.aggregate("features", F.lit(0.0), lambda s, f: s + F.coalesce(table[f], F.lit(0.0)))
        return 1 / (1 + F.exp(-score))

    return _by_kind({kind: of_kind(of) for kind, of in weights.items()}, F.lit(None).cast("double"))


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")


def scan(docs: DataFrame, path: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
         weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(path, spans) of every row of ``docs``; spans by kind as listed, then begin, ``base`` telling strict ones.

    ``weights`` of :func:`learn` are taken as they are; without them the classifier is trained on ``docs``.
    """
    rows, found = candidates(docs, path, text)
    if weights is None:
        weights = learn(found)
    likely = found.withColumn("probability", probability(weights)).withColumn("base", F.col("valid")).where(
        F.col("base") | (~F.col("strict") & (F.col("probability") >= threshold)))
    in_row = W.partitionBy("row")
    rising = [F.asc("begin"), F.desc("base"), F.asc("rank")]
    falling = [F.desc("begin"), F.asc("base"), F.desc("rank")]
    reach = F.max("until").over(in_row.orderBy(*rising).rowsBetween(W.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("begin"))).over(in_row.orderBy(*falling).rowsBetween(W.unboundedPreceding, -1))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("begin")) & (F.coalesce("ahead", F.col("until")) >= F.col("until"))
    spans = (
        likely.withColumn("rank", _rank()).withColumns({"reach": reach, "ahead": ahead}).where(F.col("base") | free)
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "begin", "until", "kind", "base", "probability"))).alias("spans"))
    )
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, "row", "left").select(F.col("path").alias(path), F.coalesce("spans", none).alias("spans"))
