import itertools
import random
import re

from lectern.llm import licenses as S
from lectern.llm.license_texts import LICENSES
from lectern.llm.queries import QUERIES

TEMPLATES = [S.Template.of(k, v, S.THRESHOLD) for k, v in LICENSES.items()]


def test_longest_rising_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randrange(9) for _ in range(rng.randrange(9))]
        got = [values[i] for i in S.rising(values)]
        best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n)
                    if all(a < b for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


def test_alignment_is_common_and_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(20))]
        b = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(20))]
        pairs = S.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(S.aligned(a, a)) == len(a)
    assert S.aligned("x a b q c y".split(), "a b c".split()) == [(1, 0), (2, 1), (4, 2)]


def names(text):
    return [(f.name, text[a:b]) for f, a, b in S.finds(text, TEMPLATES)]


def test_every_template_is_found_in_prose_and_with_edits():
    prose = " and the of in was " * 40
    for name, wording in LICENSES.items():
        words = wording.split()
        assert names(prose + wording.upper() + prose)[0][0] == name
        if len(words) > 20:
            edited = words[:5] + ["really"] + words[5:15] + words[16:]
            found = S.finds("é ß " + " ".join(edited), TEMPLATES)
            assert [f.name for f, _, _ in found] == [name] and 0.9 < found[0][0].coverage < 1
    assert names(prose) == [] and names("") == [] and names("license license license") == []


def test_copies_overlaps_and_places():
    mit = "Released under the MIT License."
    assert names(f"İ {mit} x. {mit}{mit}") == [("MIT-notice", mit[:-1])] * 3
    gpl = LICENSES["GPL-3.0-notice"]
    assert names(f"{mit}\n{gpl}") == [("MIT-notice", mit[:-1]), ("GPL-3.0-notice", gpl[:-1])]
    assert [n for n, _ in names(LICENSES["BSD-3-Clause"])] == ["BSD-3-Clause"]
    assert [n for n, _ in names(LICENSES["BSD-2-Clause"])] == ["BSD-2-Clause"]
    assert len(names((mit + " ") * 2000)) == 2000


def test_words_put_into_short_templates():
    assert names("Released under the terms and conditions of the MIT License, x") == [
        ("MIT-notice", "Released under the terms and conditions of the MIT License")]
    for name, wording in LICENSES.items():
        words = wording.split()
        if len(words) < 60:
            middle = len(words) // 2
            put = " ".join(words[:middle] + ["one", "two", "three", "four", "five"] + words[middle:])
            assert name in [n for n, _ in names(put)]
            far = " ".join(words[:middle] + ["word"] * 200 + words[middle:])
            assert name not in [n for n, _ in names(far)]


def every_stretch(text):
    """Finds with every stretch aligned that begins at any word, without looking at marks, first words or counts."""
    spans = [m.span() for m in S.WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    found = []

    def at_start(t, start, until):
        pairs = S.aligned(words[start:until], t.words)
        return (len(pairs), start, start + pairs[-1][0]) if len(pairs) >= 0.8 * len(t.words) and pairs[0][0] == 0 else None

    for i, t in enumerate(TEMPLATES):
        n, taken = len(t.words), []
        for width, tight in ((S.ceil(S.SLACK * n), False), (n + S.EXTRA, True)):
            if tight and width <= S.ceil(S.SLACK * n):
                continue
            at, before = 0, list(taken)
            for start in range(len(words)):
                if start < at or any(a <= start <= b for _, a, b in before):
                    continue
                until = min([start + width, len(words)] + [a for _, a, _ in before if a > start])
                if got := at_start(t, start, until):
                    if tight:
                        high = min([len(words)] + [a for _, a, _ in before if a > start])
                        got = max([got, *filter(None, (at_start(t, s, min(s + width, high)) for s in range(start + 1, got[2])))])
                    taken.append(got)
                    at = got[2] + 1
        found += [(-c, -c / n, i, a, b) for c, a, b in taken]
    kept = []
    for f in sorted(found):
        if all(f[4] < k[3] or k[4] < f[3] for k in kept):
            kept.append(f)
    return sorted((TEMPLATES[i].name, -c, spans[a][0], spans[b][1]) for _, c, i, a, b in kept)


def test_finds_are_those_of_every_stretch():
    rng = random.Random(9)
    pool = sorted({w for v in LICENSES.values() for w in v.split()})
    for _ in range(40):
        words = rng.choices(pool, k=rng.randrange(20))
        for wording in rng.sample(list(LICENSES.values()), 2):
            part = wording.split()
            for _ in range(rng.choice([0, 1, 3, len(part) // 6])):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = rng.choices(pool, k=rng.randrange(2))
            words += part + rng.choices(pool, k=rng.randrange(8))
        text = " ".join(words)
        assert sorted((f.name, f.coverage, a, b) for f, a, b in S.finds(text, TEMPLATES)) == every_stretch(text)


def test_odd_rows(spark):
    mit = "Released under the MIT License."
    rows = [(1, None, None), (2, "", "x"), (3, mit, "x"), (3, mit, "x"), (None, mit, None), (4, "word " * 100_000 + mit, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, coverage string")
    got = sorted((str(r.doc_id), r.license_id, r.coverage, r.begin, r.until) for r in S.scan(docs).collect())
    assert got == [("3", "MIT-notice", 1.0, 0, 30)] * 2 + [("4", "MIT-notice", 1.0, 500_000, 500_030), ("None", "MIT-notice", 1.0, 0, 30)]
    assert S.scan(docs.limit(0)).count() == 0


def test_query_finds_the_notices(spark):
    sf = "/root/testdata/sf0.01"
    notices = {k: v for k, v in LICENSES.items() if k.endswith("notice")}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for name, wording in notices.items():
            want |= {(r.doc_id, name, m.start(), m.end()) for m in re.finditer(re.escape(wording[:-1]), r.text)}
    rows = QUERIES["op9_license_patience"](spark, sf).collect()
    assert want and {(r.doc_id, r.license_id, r.begin, r.until) for r in rows if r.coverage == 1} == want
