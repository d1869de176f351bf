import random

import pytest
import xxhash

from lectern.llm import simhash as S
from lectern.llm.components import smallest_reachable

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)][:len(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    """component by position, from all pairs."""
    at = list(range(len(prints)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", "  \t\n", "one", "One", "one two", "one two three", "A\x1cB c d", "É é x", "a b c d e f g " * 50,
         "a b c d e f g " * 50 + "h", "w" * 200_000, " ".join(map(str, range(30_000)))]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCS)
    got = {r.doc_id: r.simhash % (1 << 64) for r in S.fingerprints(docs).collect()}
    assert got == {i: plain_print(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("crowd", [0, 1, 32])
def test_groups_equal_all_pairs(spark, crowd):
    rng = random.Random(3)
    codes = [0, 1, 3, (1 << 63), (1 << 64) - 1]
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            codes.append(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    prints = spark.createDataFrame(rows, "doc_id bigint, simhash bigint")
    got = prints.join(S.grouped(prints, crowd=crowd), "simhash").collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(plain_groups(codes)))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(30)]
    rows = spark.createDataFrame(chain + star + [(500, 500), (7, 6)], "src bigint, dst bigint")
    got = {r.node: r.root for r in smallest_reachable(rows).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(30)}, 500: 500}
    assert smallest_reachable(rows.limit(0)).count() == 0


def test_one_stays_of_every_group(spark):
    rows = [(5, "a b c d", "x", None, 1), (3, "A b c d", None, "s", 1), (3, "A b c d", None, "s", 1),
            (None, "a b c d", "x", None, 1), (9, "other words are here", "x", None, 1), (9, "and yet others come", "x", None, 1),
            (10, None, None, None, None), (11, "", None, None, None), (None, "only without an id", None, None, 4)]
    docs = spark.createDataFrame(rows, DOCS)
    got = S.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(got.collect(), key=str) == sorted(spark.createDataFrame(
        [rows[1], rows[4], rows[5], rows[6], rows[8]], DOCS).collect(), key=str)
    assert S.without_near_duplicates(docs.limit(0)).count() == 0


def test_query(spark):
    from lectern.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [plain_print(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, plain_groups(prints))}
    rows = QUERIES["op2_simhash_pigeonring"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want and len(rows) == len(ids)
