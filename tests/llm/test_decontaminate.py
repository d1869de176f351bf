import os
import random
import re
import subprocess
import sys
from collections import Counter

from lectern.llm import decontaminate as D
from lectern.llm.oracle import ORACLE
from lectern.llm.queries import QUERIES
from oracle_check import compare, connect


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws, width):
    return [tuple(ws[i:i + width]) for i in range(len(ws) - width + 1)]


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def plain(docs, items, threshold=0.8):
    """{(doc, item): best similarity} over all windows."""
    out = {}
    for d, text in docs:
        ws = words(text)
        for i, item in items:
            iw = words(item)
            if not iw:
                continue
            width = min(5, len(iw))
            known = shingles(iw, width)
            for at in range(max(len(ws) - len(iw), 0) + 1):
                here = shingles(ws[at:at + len(iw)], width)
                if set(here) & set(known) and (s := similarity(here, known)) >= threshold:
                    out[d, i] = max(s, out.get((d, i), 0))
    return out


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS mark", "1 AS size")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "2 AS block")
    rows = D.contaminated(d, b).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
    assert got == {k: round(v, 9) for k, v in plain(docs, items).items()}
    return rows


def test_equals_all_windows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, prose(rng.randint(1, 70))) for i in range(25)]
    docs = []
    for n in range(120):
        _, item = rng.choice(items)
        copy = list(item)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(copy))
            edit = rng.randrange(4)
            if edit == 0:
                copy[at] = "edited"
            elif edit == 1:
                copy.insert(at, "more")
            elif edit == 2 and len(copy) > 1:
                del copy[at]
        docs.append((n, " ".join(prose(rng.randint(0, 30)) + copy + prose(rng.randint(0, 30)))))
    check(spark, docs, [(i, " ".join(w)) for i, w in items])


def test_odd_rows(spark):
    passage = "The same, old passage of a benchmark that has twelve words or so"
    items = [(1, passage), (2, passage.upper()), (3, None), (4, ""), (5, "..."), (6, "two words"), (7, "a b a b a b a b a b a b")]
    docs = [(1, None), (2, ""), (3, "!!"), (4, passage), (4, passage), (5, "x " * 50_000 + passage + " y" * 50_000),
            (6, "two"), (7, "a b a b a b a b a b a b a b a b"), (8, "say two words"), (None, passage)]
    rows = check(spark, docs, items)
    assert {(r.doc_id, r.start_word) for r in rows if r.item_id == 1} == {(4, 0), (5, 50_000), (None, 0)}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame(items, "item_id bigint, text string")
    assert D.contaminated(empty, some).count() == 0
    assert D.contaminated(spark.createDataFrame(docs, empty.schema), none).count() == 0
    left = D.without_contaminated(spark.createDataFrame(docs, empty.schema), some)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 6]


def test_radius_is_guaranteed_by_blocks(spark):
    rng = random.Random(1)
    rows = []
    for n in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, D.RADIUS)):
            b ^= 1 << bit
        rows.append((n, *(x - (1 << 64) if x >> 63 else x for x in (a, b))))
    pairs = spark.createDataFrame(rows, "n int, a bigint, b bigint")
    left = pairs.selectExpr("n", "a AS code").select("n", D.F.inline(D._blocks("code", False)))
    right = pairs.selectExpr("n", "b AS code").select("n", D.F.inline(D._blocks("code", True)))
    assert left.join(right, ["n", "block", "value"]).select("n").distinct().count() == 300


def test_keys_prune(spark):
    rng = random.Random(8)
    schema = "digest int, shingles array<bigint>"
    rows = [(n, [rng.getrandbits(62) for _ in range(46)]) for n in range(200)]
    near = [(n, s[:41] + [rng.getrandbits(62) for _ in range(5)]) for n, s in rows]

    def keyed(rows, variants):
        frame = spark.createDataFrame(rows, schema).selectExpr("*", "50 AS size", "5 AS width")
        frame = frame.withColumns({"code": D.simhash(D.F.col("shingles")), "bag": D._bag(D.F.col("shingles"))})
        return D._keyed(frame, variants, D.THRESHOLD)

    met = keyed(near, False).join(keyed(rows, True).selectExpr("key", "digest AS item"), "key").select("digest", "item").distinct().collect()
    assert {r.digest for r in met if r.digest == r.item} == set(range(200))
    assert len(met) <= 200 + 0.001 * 200 * 200


def test_items_that_share_an_id_or_a_text(spark):
    one, other = (" ".join(f"{w}{i}" for i in range(20)) for w in ("left", "right"))
    rows = check(spark, [(1, one), (2, f"before {other} after"), (3, one + " " + other)], [(7, one), (7, other), (8, one)])
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 7), (1, 8), (2, 7), (3, 7), (3, 8)}


def test_many_items_pass_a_bloom_filter(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 0)
    assert check(spark, docs, items)
    monkeypatch.setattr(D, "BLOOM_BITS", 1 << 10)  # too small: lets too much through, loses nothing
    check(spark, docs, items)


def test_bloom_filter_keeps_all_and_little_else(spark):
    known = spark.range(5000).select(D.F.xxhash64("id").alias("h"))
    may = D._bloom(known, 5000, D.BLOOM_BITS)
    assert known.where(may(D.F.col("h"))).count() == 5000
    assert spark.range(10_000, 110_000).select(D.F.xxhash64("id").alias("h")).where(may(D.F.col("h"))).count() < 2000


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in QUERIES["op7_decontamination"](spark, sf).collect()}
    assert got and got == {k: round(v, 9) for k, v in plain(docs, items).items()}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op7_decontamination"](spark, sf), connect(sf), ORACLE["op7_decontamination"]) is None


def test_windows_count_for_the_broadcast(spark, monkeypatch):
    from lectern.llm import decontaminate

    asked, join = [], decontaminate.joined
    monkeypatch.setattr(decontaminate, "joined", lambda *a: asked.append(a[4]) or join(*a))
    docs = spark.createDataFrame([(1, "w " * 60), (2, "other words of no item")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "w " * 20)], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, items).collect()] == [1]
    assert asked == [1 + 41]  # one document, a window at each of 41 places


def test_item_index_stays_off_the_driver(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = D.contaminated(docs, spark.createDataFrame([(1, text)], "item_id bigint, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[.*\[item_size", plan) == ["SortMergeJoin"]
    assert [r.similarity for r in found.collect()] == [1.0]


def test_keys_of_items_can_be_compiled(spark):
    kinds = "size int, width int, digest struct<a: bigint, b: bigint>, code bigint, bag array<bigint>"
    rows = spark.createDataFrame([(50, 5, (i, i), i * 12345678901, [i, i + 1]) for i in range(3)], kinds)
    changed = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert D._keyed(rows, True, D.THRESHOLD).count() == 3 * 8 * 37
    finally:
        for k in changed:
            spark.conf.unset(k)


IN_LITTLE_MEMORY = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from lectern.llm import decontaminate as D

conf = {"spark.master": "local[1]", "spark.driver.memory": "600m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
        "spark.checkpoint.dir": sys.argv[1]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
passage = " ".join(f"p{i}" for i in range(40))
other = " ".join(f"w{i}" for i in range(1000)) + " "
text = F.repeat(F.concat(F.repeat(F.lit(other), 50), F.lit(passage + " ")), 40)  # two million words, 40 windows
docs = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
found = D.contaminated(D.staged(docs, "docs"), spark.createDataFrame([(7, passage)], "item_id bigint, text string")).collect()
assert [(r.doc_id, r.item_id, r.similarity, r.start_word, r.n_words) for r in found] == [(0, 7, 1.0, 50_000, 40)], found
"""


def test_words_of_a_long_text_in_little_memory(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    done = subprocess.run([sys.executable, "-c", IN_LITTLE_MEMORY, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_pieces_hold_all_words_in_order(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_CHARS", 20)
    monkeypatch.setattr(D, "PIECE_WORDS", 6)
    rng = random.Random(1)
    texts = [None, "", "..." * 20, "!! " * 30 + "x", "é" * 50, "a1 b2 " * 9 + "!!! " * 40, "\U0001f600 x" * 40]
    texts += ["".join(rng.choice("ab \U0001f600.é1") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in D._pieces(docs, ["doc_id"]).orderBy("doc_id", "first").collect():
        got.setdefault(r.doc_id, []).append(r)
    for n, text in enumerate(texts):
        w = words(text)
        assert sum((r.words[:r.own] for r in got.get(n, [])), []) == w
        for r in got.get(n, []):
            assert r.n_words == len(w) and r.words == w[r.first:r.first + r.own + D.SHINGLE_WORDS - 1]


def test_windows_over_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_CHARS", 20)
    monkeypatch.setattr(D, "PIECE_WORDS", 6)
    test_equals_all_windows(spark)
    test_items_that_share_an_id_or_a_text(spark)


def test_keys_are_dealt_to_enough_tasks(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    whole = [tuple(r) for r in D.contaminated(docs, items).collect()]
    monkeypatch.setattr(D, "KEYS_A_TASK", 500)  # a text and an item of 56 shingles: 13 * 8 and 13 * 8 * 37 keys
    found = D.contaminated(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [int(n) for n in re.findall(r"hashpartitioning\((?:item_)?size#.*key#.*, (\d+)\), REPARTITION_BY_NUM", plan)] == [8, 8]
    assert [tuple(r) for r in found.collect()] == whole and len(whole) == 1
