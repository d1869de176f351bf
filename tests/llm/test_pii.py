import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import pii as P
from lectern.llm.queries import QUERIES, op11_digest

# the plain patterns, in Python's dialect
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", True),
    ("card", r"[0-9]([\x20-]?[0-9])+", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    ("email", r"[A-Za-z0-9._%+-]+\x20?[\[({]\x20?(?ai:at)\x20?[\])}]\x20?[A-Za-z0-9-]+"
              r"(?:(?:\.|\x20?[\[({]\x20?(?ai:dot)\x20?[\])}]\x20?)[A-Za-z0-9-]+)+", False),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", False),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", False),
]


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def touching(c):
    return "edge" if not c else "space" if c in " \t\n\x0b\x0c\r" else "word" if c.isalnum() or c == "_" else "mark"


def says(words, left):
    return re.search(rf"(?:^|[^a-záéíóúñäöüß])(?:{words})(?:[^a-záéíóúñäöüß]|$)", left.lower()) is not None


def vote(agrees, objects):
    return P.AGAINST if objects else P.FOR if agrees else P.ABSTAIN


def candidates(text):
    """(kind, begin, end, strict, valid, votes, features) in plain Python."""
    out = []
    for kind, pattern, strict in PLAIN:
        found = list(re.finditer(pattern, text))
        for i, m in enumerate(found):
            left = text[found[i - 1].end() if i else 0 : m.start()][-40:]
            right = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)][:1]
            s, digits = m[0], re.sub("[^0-9]", "", m[0])
            if kind == "card" and not 13 <= len(digits) <= 19:
                continue
            good = strict and valid(kind, s)
            cue = "for" if says(P.CUES[kind], left) else "against" if says(P.COUNTER_CUES, left) else "none"
            domain = re.search("[A-Za-z0-9-]*$", s)[0].lower()
            shape, gazetteer = {
                "email": (vote(re.match("[A-Za-z0-9][^@]{0,62}[A-Za-z0-9]@", s), re.search(r"^[.]|[.]@|@-|-[.]|-$|[.][.]", s)),
                          vote(domain in P.DOMAINS, re.fullmatch("[0-9-]+", domain))),
                "ip": (vote(not re.search(r"(?:^|\.)0[0-9]", s), False),
                       vote(True, re.search(P.RESERVED, s)) if strict else vote(s[:1] in "23", re.match("(?i:fe80|f[cd]|0)", s))),
                "card": (vote(re.fullmatch(r"[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", s), False),
                         vote(re.match(P.ISSUERS, digits), not re.match(P.ISSUERS, digits))),
                "phone": (vote(re.search(r"[0-9]{2,4}[\x20).-]{1,2}[0-9]{2,4}[\x20.-][0-9]{2,4}$", s), s.count("(") != s.count(")")),
                          vote(re.match(P.CODES, digits) if strict else digits[:1] >= "2", False)),
            }[kind]
            form = P.ABSTAIN if not strict else P.FOR if good else P.AGAINST
            context = {"for": P.FOR, "against": P.AGAINST, "none": P.ABSTAIN}[cue]
            edges = P.AGAINST if "word" in (touching(left[-1:]), touching(right)) else P.FOR
            marks = "".join(sorted(set(re.findall(r"[\x20().\[\]:@-]", s))))
            style = {"": "none", " ": "spaces", "-": "dashes", ".": "dots"}.get(marks) or (
                "round" if "(" in marks else "square" if "[" in marks else "at" if "@" in marks else "mixed")
            features = ("form=" + ("loose" if not strict else "strict" if good else "failed"), "before=" + touching(left[-1:]),
                        "after=" + touching(right), f"length={min(len(s) // 6, 5)}", f"digits={min(len(digits) // 4, 5)}",
                        "marks=" + style, "cue=" + cue)
            votes = sum(v * 3**k for k, v in enumerate((form, shape, gazetteer, context, edges)))
            out.append((kind, m.start(), m.end(), strict, good, votes, features))
    return out


def plain_em(rows):
    """Posterior of every pattern, one number at a time."""
    likely = {}
    for v in rows:
        votes = [v // 3**i % 3 for i in range(5)]
        likely[v] = 0.9 if 2 not in votes else 0.5 if votes[0] == 1 else 0.1
    for _ in range(P.ROUNDS):
        share = [1 + sum(n * (1 - likely[v]) for v, n in rows.items()), 1 + sum(n * likely[v] for v, n in rows.items())]
        rates = []
        for i in range(5):
            rate = [[1.0, 0.5, 2.0], [1.0, 2.0, 0.5]]
            for v, n in rows.items():
                rate[0][v // 3**i % 3] += n * (1 - likely[v])
                rate[1][v // 3**i % 3] += n * likely[v]
            rates.append([[x / sum(r) for x in r] for r in rate])
        now = {}
        for v in rows:
            personal, other = share[1], share[0]
            for i in range(5):
                personal *= rates[i][1][v // 3**i % 3]
                other *= rates[i][0][v // 3**i % 3]
            now[v] = personal / (personal + other)
        change = max(abs(now[v] - likely[v]) for v in rows)
        likely = now
        if change < 1e-9:
            break
    return likely


def plain_spans(texts):
    """Spans of every text, learned from all of them."""
    found = [candidates(t or "") for t in texts]
    counts = Counter((c[0], c[5], c[6]) for of in found for c in of)
    weights = {}
    for kind in P.KINDS:
        rows = sorted((v, f, n) for (k, v, f), n in counts.items() if k == kind)
        if rows:
            patterns = Counter()
            for v, _, n in rows:
                patterns[v] += n
            likely = plain_em(patterns)
            weights[kind] = P.fitted([(f, likely[v], n) for v, f, n in rows])
    out = []
    for of in found:
        kept, reach = [], 0
        base = [c for c in of if c[4]]
        accepted = [c for c in of if not c[3] and 1 / (1 + np.exp(-sum(weights[c[0]][f] for f in c[6]))) >= P.THRESHOLD]
        for c in sorted(base + accepted, key=lambda c: (c[1], not c[4], P.KINDS.index(c[0]))):
            clear = reach <= c[1] and not any(b[1] >= c[1] and b[1] < c[2] for b in base)
            if c[4] or clear:
                kept.append((P.KINDS.index(c[0]), c[1], c[2], c[4]))
            reach = max(reach, c[2])
        out.append([(P.KINDS[k], a, b, g) for k, a, b, g in sorted(kept)])
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], "doc_id bigint, text string, kind string, spans string")


def spans_of(found):
    return {r.doc_id: [(s.kind, s.begin, s.until, s.base) for s in r.spans] for r in found.collect()}


TEXTS = [
    None, "", "nothing", "Mail a.b@c.example.com_x@d.org, or x@y", "é😀 a@b.co.uk😀@-.com", "@@a@b.c@d.e.f", "a..b@-c.d-", "a@b.c" * 50,
    "IP 10.0.0.1 host 300.1.1.1 and 1.2.3.4.5.6.7.8 000000255.1.1.256 1.2.3", "0001.0255.3.04", "1.2.3.4" + "5" * 400,
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111111111111111 79927398713 0000000000000", "1 " * 300, "9" * 19 + " " + "0" * 18,
    "+1 (212) 555-0153, call +49 30 1234567. +1 +12 +123456789012345678 +1((((9 +1) 2 (3", "+1.2.3.4.5.6.7.8.9.10.11.12.13.14",
    "tel (212) 555-0153 or 212-555-0154; version 123-456-7890, 212 555 0155x order 212.555.0156", "call 333-555-1234 call 333-555-1235",
    "write to jane.doe [at] mail [dot] example [dot] com or bob(at)example.org, x (at) y", "a{at}b.c{AT}d.e",
    "ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334 and fe80:0:0:0:0:0:0:1 1:2:3:4:5:6:7:8:9", "12:30:45",
    "phone 212-555-0188 fax:\t212-555-0189\n212-555-0190_", "212 555 4111 1111 1111 1111", "+44 212 555 0153 212-555-0154",
]
LONG = ["a" * 200_000, "1" * 200_000, "a.b-" * 50_000, "x@" + "a." * 50_000 + "a", "1." * 100_000, "+1" + "." * 100_000,
        "1 " * 100_000, " ".join(f"u{i}@mail.example.com" for i in range(3000))]


def test_spans_equal_plain(spark):
    got = spans_of(P.scan(frame(spark, TEXTS)))
    assert [got[i] for i in range(len(TEXTS))] == plain_spans(TEXTS)
    assert any(not s[3] for of in got.values() for s in of)  # some were added


def test_very_long_texts(spark):
    got = spans_of(P.scan(frame(spark, LONG)))
    for i, t in enumerate(LONG[:1] + LONG[2:4] + LONG[5:6]):
        base = [("email", m.start(), m.end(), True) for m in re.finditer(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", t)]
        assert got[LONG.index(t)] == base
    assert len(got[7]) == 3000 and not got[1] and not got[6]
    assert got[4] == [("ip", a, a + 7, True) for a in range(0, 200_000 - 7, 8)]


def test_random_texts_equal_plain(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", " ", "+", "1", "22", "333", "4444", "(", ")", "tel ", "[at]", "[dot]", "com", ":", "é", "_", "\n",
             "212-555-0100", "4111111111111111", "10.0.0.1", "+49 30 1234567", "x@y.com"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    got = spans_of(P.scan(frame(spark, texts)))
    assert [got[i] for i in range(len(texts))] == plain_spans(texts)


def test_classifier_goes_by_the_reliable_labelers(spark):
    rng = random.Random(5)
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    good = [f"Please call {number()}, thanks" for _ in range(60)] + [f"tel +1 {number()}" for _ in range(60)]
    bad = [f"version {number().replace('-', '.')}" for _ in range(60)]
    got = spans_of(P.scan(frame(spark, good + bad)))
    assert all(len(got[i]) == 1 for i in range(120)) and not any(got[i] for i in range(120, 180))


def test_estimates_equal_plain():
    rng = random.Random(7)
    for _ in range(10):
        rows = {rng.randrange(243): rng.randrange(1, 50) for _ in range(rng.randrange(1, 30))}
        patterns = sorted(rows)
        want = plain_em(rows)
        got = P.estimated(np.array(patterns), np.array([rows[p] for p in patterns]))
        assert np.allclose(got, [want[p] for p in patterns], atol=1e-7)


def test_null_ids_repeated_rows_and_empty_table(spark):
    schema = "doc_id bigint, text string"
    rows = [(None, TEXTS[3]), (1, TEXTS[3]), (1, TEXTS[3]), (2, None)]
    found = P.scan(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), len(r.spans)) for r in found) == [("1", 2), ("1", 2), ("2", 0), ("None", 2)]
    assert P.scan(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_plain(spark, sf):
    rows = QUERIES["op11_weak_pii"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, plain_spans(list(texts.values()))))
    assert len(rows) == len(texts)
    for r in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b, g in want[r.doc_id] if g)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x and g for k, _, _, g in want[r.doc_id]) for x in P.KINDS]


def test_added_spans_stay_out_of_the_base_digest(spark):
    row = op11_digest(P.scan(frame(spark, [TEXTS[16]] + ["call 212-555-0100"] * 20)), "doc_id").where("doc_id = 0").first()
    assert row.n_phone == 0 and row.base_sha256 == hashlib.sha256(b"").hexdigest() and row.spans.startswith("phone:4:18")
