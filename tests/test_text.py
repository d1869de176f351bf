import random

from pyspark.sql import functions as F

import lectern as L
from lectern.functions.folds import pack_entries, pack_passages, pieces
from lectern.functions.text import embedding_text, strip

MARK = "...[truncated]"


def packed(entries, limit):
    """The packing rule in plain words: equal shares, cut at a border in the second half, stop when full."""
    share, out, used = limit // max(len(entries), 1), [], 0
    for e in entries:
        room = limit - used
        if room <= 0:
            break
        if len(e) > share and room > 100:
            e = e[: min(share, room)]
            border = e.rfind(" | ")
            e = (e[:border] if border > len(e) / 2 else e) + "\n" + MARK
        if len(e) <= room:
            out.append(e)
            used += len(e)
        elif room > 50:
            out.append(e[:room] + MARK)
            break
    return "\n\n".join(out)


def chunked(text, size):
    """Parts begin at a source header; a part opens a new chunk when it would overfill a started one."""
    parts, at = [], 0
    while at < len(text):
        nxt = at + 1
        while nxt < len(text) and not header(text, nxt):
            nxt += 1
        parts.append(text[at:nxt])
        at = nxt
    done = []
    for p in parts:
        if done and len(done[-1]) + len(p) <= size:
            done[-1] += p
        else:
            done.append(p)
    return done or ["No relevant document passages found."]


def header(text, at):
    tail = text[at:at + 20]
    return tail.startswith("[Source ") and tail[8:].split("]")[0].isdigit() and "] " in tail


def test_strip_knows_all_white_space(spark):
    row = spark.createDataFrame([(" \t\x1c a　b \n ",)], "s string").select(strip(F.col("s")).alias("s"))
    assert row.first().s == "a　b"


def test_embedding_text(spark):
    rows = [(1, " a ", "b", "a", None, ["k"]), (2, "\t", "", None, " ", []), (3, None, "x", " x", "y ", None)]
    df = spark.createDataFrame(
        rows, "doc_id int, title string, description string, remark string, comment string, keywords array<string>"
    )
    out = [r.t for r in df.orderBy("doc_id").select(embedding_text(df).alias("t")).collect()]
    assert out == ["b a", "", "x y"]


def test_passages(spark):
    rows = [(1, "d", " t ", None, "e"), (2, None, "\n", " ", "x" * 600), (3, "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, description string, title string, remarks string, embedded_text string")
    out = {r.doc_id: r.passage for r in L.passages(df).collect()}
    assert out == {1: "description: d | title: t", 2: "x" * 500}


def random_entries(rng):
    out = []
    for i in range(rng.choice([0, 1, 2, 3, 9, 30])):
        body = "".join(rng.choice(["word ", "é😀", " | ", "x", "\n"]) for _ in range(rng.choice([1, 5, 40, 400])))
        out.append(f"[Source {i + 1}] (score: 0.5)\n{body}")
    return out


def test_pack_entries_matches_the_rule(spark):
    rng = random.Random(7)
    cases = [random_entries(rng) for _ in range(150)] + [["y" * 500], ["y" * 400] * 3, ["a" * 95, "b" * 300, "c" * 10]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, e array<string>")
    for limit in (60, 300, 1000, 8000):
        got = {r.i: r.t for r in df.select("i", pack_entries(F.col("e"), limit).alias("t")).collect()}
        for i, c in enumerate(cases):
            assert got[i] == packed(c, limit), (limit, i)


def test_cutting_entries_early_changes_nothing(spark):
    rng = random.Random(8)
    cases = [random_entries(rng) for _ in range(60)]
    for limit in (60, 300, 1000):
        for c in cases:
            assert packed(c, limit) == packed([e[: limit + 1] for e in c], limit)


def test_chunks_match_the_rule(spark):
    rng = random.Random(9)
    cases = ["\n\n".join(random_entries(rng)) for _ in range(60)]
    cases += ["", "no header", "lead [Source 3] x [Source x] y", "[Source 1] " + "z" * 4000 + "[Source 2] b"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    for size in (50, 500, 3000):
        got = {r.i: r.c for r in df.select("i", pack_passages(F.col("t"), size).alias("c")).collect()}
        for i, c in enumerate(cases):
            assert got[i] == chunked(c, size), (size, i)


def test_chunk_cap_is_counted(spark):
    text = "".join(f"[Source {i}] " + "x" * 2500 for i in range(1, 12))
    rows = L.chunk_context(spark.createDataFrame([(1, text), (2, None)], "qid int, context string")).collect()
    long = sorted((r for r in rows if r.qid == 1), key=lambda r: r.chunk_no)
    assert [r.chunk_no for r in long] == list(range(1, 9))
    assert {(r.n_chunks, r.n_dropped) for r in long} == {(8, 3)}
    assert [r.chunk for r in rows if r.qid == 2] == ["No relevant document passages found."]


def test_context_skips_empty_passages_and_keeps_ranks(spark):
    rows = [(1, 1, 0.9, "a"), (1, 2, 0.8, " "), (1, 3, 0.7, "c")]
    hits = spark.createDataFrame(rows, "qid int, rk int, score double, title string")
    text = L.build_context(hits).first().context
    assert text == "[Source 1] (score: 0.9000)\ntitle: a\n\n[Source 3] (score: 0.7000)\ntitle: c"


def test_pieces(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],), ([1, 2],)], "a array<int>")
    got = [r.p for r in df.select(pieces(F.col("a"), 2).alias("p")).collect()]
    assert got == [[[1, 2], [3, 4], [5]], [], [[1, 2]]]
