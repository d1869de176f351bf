import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import collocations as C
from lectern.llm.oracle import ORACLE
from lectern.llm.queries import QUERIES
from oracle_check import compare, connect

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pieces(text):
    cut = re.split("[.,;:!?\n-\r]", (text or "").translate(SMALL))
    return [[w for w in re.split("[ \t]+", p) if w] for p in cut]


def plain(rows, depth=3, least=10, first=2000, covered=50):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            sizes[lang] += len(words)
            for m in range(1, depth + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p for p in f if len(p) > 1 and f[p] >= least}
        covering = Counter()
        for p in candidates:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covering[p[i : i + m]] = max(covering[p[i : i + m]], f[p])
        scored = []
        for p in candidates:
            if 100 * covering[p] >= covered * f[p]:
                continue
            score, k = min((10**6 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, rows):
    rows = [(lang, text, "x", 1) for lang, text in rows]
    return spark.createDataFrame(rows, "lang string, text string, phrase string, n bigint")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql_and_plain(spark, sf):
    found = QUERIES["op13_phrase_collocations"](spark, sf)
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(found) == plain(rows)
    assert compare(found, connect(sf), ORACLE["op13_phrase_collocations"]) is None


ODD = [
    (None, "Of the of the of the"), ("und", "of the\tof the"), ("en", None), ("en", ""), ("en", " \t"), ("en", ".,;"), ("en", "one"),
    ("en", "new york city. New  York\tcity, new york! ÉCOLE é É"), ("en", "New York City\x0bnew york city\x0cnew york"),
    ("fr", "New York city new york city"), ("fr", "a a a a a a a a a a a a"), ("de", "x " * 90),
]


@pytest.mark.parametrize("budget", [40, C.BUDGET])
def test_odd_texts_and_split_prefixes(spark, budget):
    rows = ODD * 3 + [("en", "the cat sat. the cat ran. the dog sat " * 15)]
    for least, depth in ((2, 3), (3, 4), (1, 2)):
        found = C.collocations(frame(spark, rows), least=least, max_words=depth, budget=budget)
        assert got(found) == plain(rows, depth, least)


def test_ties_and_the_first_ranks(spark):
    rows = [("en", ". ".join(f"a{i} b{i}" for i in range(30)))] * 12 + [(None, "Z z. z Z. é z")] * 10
    assert got(C.collocations(frame(spark, rows), first=7)) == plain(rows, first=7)


def test_no_candidates(spark):
    for rows in ([], [("en", None)], [("en", "all words here are rare")]):
        assert got(C.collocations(frame(spark, rows))) == []


def test_arithmetic_is_exact(spark):
    for a, left, right in ((99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999), (3_000_000_019, 3_000_000_021, 4_000_000_000_007)):
        row = spark.sql(f"select {a}L a, {left}L l, {right}L r").selectExpr(
            "cast(1000000 as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0))"
            " div (cast(l as decimal(14,0)) * cast(r as decimal(14,0))) score").first()
        assert row.score == 10**6 * a * a // (left * right)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \t.é\n", max_size=25) | st.none(), max_size=8), st.integers(1, 20))
def test_windows_hold_every_word(texts, size):
    texts = texts + [None]
    langs = [f"l{i % 2}" for i in range(len(texts))]
    found = defaultdict(list)
    for w in C.windows(pa.array(texts, pa.string()), pa.array(langs), size):
        names, lang = w.names.to_pylist(), w.langs.to_pylist()
        assert (np.bincount(w.at, minlength=len(names)) == w.times).all()
        run = []
        for at, on in zip(w.at, w.goes_on):
            run.append(names[at])
            if not on:
                found[lang[at]].append(run)
                run = []
        assert not run
    for which in set(langs):
        want = [p for t, lang in zip(texts, langs) if lang == which for p in pieces(t) if p]
        assert found[which] == want


@pytest.mark.parametrize("clashes", [1, 3, 1 << 20])
def test_nodes_that_share_a_number_are_added_up(monkeypatch, clashes):
    texts = ["a b c. a b d. b a c c a. x a b c"] * 6 + ["b a b c. d d d d", None, ""]
    langs = ["en", "de"] * 4 + ["en"]
    monkeypatch.setattr(C.Words, "hashes", lambda w: (np.arange(len(w.names)) % clashes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    plan = C.Partitioning(C.Frequent(np.full(4096, 255, np.uint8), np.zeros(0, np.uint64)), np.zeros(C.SLOTS, np.int32), 1, 0)
    leaves = pa.Table.from_batches([C._suffixes(w, plan, 3) for w in C.windows(pa.array(texts), pa.array(langs), 40)])
    leaves = leaves.sort_by("number").cast(pa.schema([(f.name, pa.string()) if f.name == "path" else (f.name, f.type) for f in leaves.schema]))
    found, whole = Counter(), Counter()
    for batch in C._nodes(leaves.to_batches(max_chunksize=7), 3, 1):
        for r in batch.to_pylist():
            found[r["lang"], r["phrase"]] += r["f"]
            whole[r["lang"], r["phrase"]] += r["whole"]
    want = Counter()
    for lang, text in zip(langs, texts):
        for p in pieces(text):
            want.update((lang, " ".join(p[i : i + m])) for m in (1, 2, 3) for i in range(len(p) - m + 1))
    assert found == want and all(n <= 1 for n in whole.values())
