import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from lectern.llm import fingerprint as P
from lectern.llm.queries import QUERIES


def jaccard(a, b):
    a, b = (Counter(t.lower().encode().split()) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain_sample(text):
    """(word, level) of every sample, word by word."""
    weights = Counter(text.lower().encode().split())
    best = [(float("inf"), b"", 0)] * P.SAMPLES
    for word in sorted(weights):
        fixed, r, b = (x[0] for x in P.drawn(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64)))
        for s in range(P.SAMPLES):
            t = np.floor(np.float32(np.log(weights[word])) / r[s] + b[s])
            value = fixed[s] - r[s] * t
            if value < best[s][0]:
                best[s] = (value, word, int(t))
    return [(word, t) for _, word, t in best]


def test_drawn_numbers_have_their_distributions():
    terms = np.random.default_rng(3).integers(0, 1 << 64, 4000, np.uint64)
    fixed, r, b = (x.astype(float) for x in P.drawn(terms))
    c = np.exp(fixed + r - r * b)
    for values, mean, variance in ((r, 2, 2), (c, 2, 2), (b, 0.5, 1 / 12)):
        assert abs(values.mean() - mean) < 0.02 and abs(values.var() - variance) < 0.05
        assert abs(values.mean(axis=0) - mean).max() < 0.12
    for one, two in ((r, c), (r, b), (b, c), (r[:, 0], r[:, 1]), (c[:-1], c[1:])):
        assert abs(np.corrcoef(one.ravel(), two.ravel())[0, 1]) < 0.06


def test_texts_without_a_common_word_are_unlike():
    for n in (200, 20_000, 60_000):
        one, two = (P.of_text(" ".join(f"{k}{i}" for i in range(n))) for k in "ab")
        assert P.likeness(one, two) < 0.02
    half = P.of_text(" ".join([f"a{i}" for i in range(30_000)] + [f"b{i}" for i in range(30_000)]))
    assert abs(P.likeness(half, P.of_text(" ".join(f"a{i}" for i in range(60_000)))) - 1 / 3) < 0.13


def test_numbers_at_hand_are_the_drawn_ones(monkeypatch):
    texts = [" ".join(f"{k}{i * k}" for i in range(50)) for k in range(1, 9)] + ["a a b"]
    whole = [P.of_text(t) for t in texts]
    P._kept.cache_clear()
    monkeypatch.setattr(P, "KEPT", 4)
    try:
        assert all((P.of_text(t) == w).all() for t, w in zip(texts + texts, whole + whole))
    finally:
        P._kept.cache_clear()
    P._kept.cache_clear()


def test_samples_are_those_of_the_method():
    texts = ["a b c d e f a a b", "a b c d e f g a a a a", "x y z"]
    signs = [P.of_text(t) for t in texts]
    plain = [plain_sample(t) for t in texts]
    for i in range(3):
        for j in range(3):
            assert ((signs[i] == signs[j]) == [p == q for p, q in zip(plain[i], plain[j])]).all()


def test_collision_rate_is_the_similarity():
    rng = random.Random(4)
    errors = []
    for n in range(200):
        words = [rng.choice([f"w{n}.{i}" for i in range(60)]) for _ in range(rng.randint(20, 300))]
        cut = rng.randint(0, len(words))
        other = words[:cut] + [rng.choice([f"v{n}.{i}" for i in range(60)]) for _ in range(len(words) - cut)]
        a, b = " ".join(words), " ".join(other)
        errors.append(P.likeness(P.of_text(a), P.of_text(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_parts_do_not_matter(monkeypatch):
    text = " ".join(f"w{i % 97} x{i % 1013}" for i in range(5000))
    whole = P.of_text(text)
    monkeypatch.setattr(P, "TERMS_AT_ONCE", 7)
    assert (P.of_text(text) == whole).all() and P.of_text(" \n") is None and P.likeness(None, None) == 1.0


def rows_by_plain(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        signs = [P.of_text(t) for t in (text, changed, following)]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), P.as_text(signs[0]), P.as_text(signs[1]),
                    P.likeness(signs[0], signs[1]), P.likeness(signs[0], signs[2])))
    return sorted(out, key=str)


def signed(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_documents(spark, parts):
    rng = random.Random(parts)
    docs = [(rng.randrange(10**9) - 10**6, " ".join(rng.choices(["é", "b", "🙂", "dd"], k=rng.randint(0, 30)))) for _ in range(150)]
    docs += [(7, "same"), (7, "same"), (7, "other"), (None, "n"), (None, None), (8, None), (9, "long " * 30_000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS fingerprint", "1 AS range")
    got = sorted((tuple(r) for r in P.compared(frame, parts=parts).collect()), key=str)
    assert got == rows_by_plain(docs)


def test_few_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.compared(none).count() == 0 and P.fingerprints(none).count() == 0
    one = spark.createDataFrame([(3, "one two")], none.schema)
    assert [tuple(r) for r in P.compared(one).collect()] == rows_by_plain([(3, "one two")])
    lost = spark.createDataFrame([(None, "one two"), (None, "three")], none.schema)
    assert sorted(map(tuple, P.compared(lost).collect()), key=str) == rows_by_plain([(None, "one two"), (None, "three")])
    assert P.fingerprints(lost).first().fingerprint == P.as_text(P.of_text("one two"))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op5_weighted_sampling"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == rows_by_plain(docs)
