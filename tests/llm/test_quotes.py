import random
import re

import duckdb
import pytest

from lectern.llm import quotes as Q
from lectern.llm.oracle import ORACLE
from lectern.llm.queries import QUERIES
from oracle_check import compare, connect

MESSAGES = "conv_id bigint, turn bigint, role string, text string, body string"


def lines_of(text):
    out = []
    for raw in re.split(r"\r?\n", text or ""):
        mark = re.match(r"^\s{0,3}(?:>\s?)+", raw)
        out.append((mark[0].count(">") if mark else 0, raw[mark.end():] if mark else raw))
    return out


def body_of(text):
    lines = lines_of(text)
    own = [b for i, (d, b) in enumerate(lines) if d == 0 and not (
        re.match(r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$", b) and i + 1 < len(lines) and lines[i + 1][0])]
    return "\n".join(own).strip()


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def units(text, least=1):
    found = [(0, normal(text))] + [(1, normal(p)) for p in re.split(r"\n\s*\n", text)]
    small = [(2, normal(x)) for x in text.split("\n")]
    small += [(3, normal(x)) for x in re.split(r"\n\s*\n|[.!?…]+[ \t\r\n]+|[。！？]+", text)]
    found += [(k, u) for k, u in small if len(u.split(" ")) >= least]
    return [(k, u) for k, u in found if u]


def plain(messages):
    own = {}
    for conv, turn, _, text in messages:
        if None not in (conv, turn, text):
            for _, u in units(body_of(text)):
                own.setdefault((conv, u), []).append(turn)
    rows, reply = [], {}
    for conv, turn, role, text in messages:
        passages, last = [], None
        for depth, body in lines_of(text):
            if depth and depth == last:
                passages[-1][1].append(body)
            elif depth:
                passages.append((depth, [body]))
            last = depth
        links = []
        for i, (depth, found) in enumerate(passages):
            for kind, u in units("\n".join(found), Q.LINE_WORDS):
                before = [t for t in own.get((conv, u), []) if turn is not None and t < turn]
                if before:
                    links.append((depth, kind, -max(before), i))
        to = -min(links)[2] if links else None
        known = None not in (conv, turn)
        if to is not None:
            reply[conv, turn] = min(to, reply.get((conv, turn), to))
        rows.append([conv, turn, role, body_of(text), max(d for d, _ in lines_of(text)), len(passages) if known else 0,
                     len({x[3] for x in links}), to])
    out = []
    for row in rows:
        thread = row[1]
        while (row[0], thread) in reply:
            thread = reply[row[0], thread]
        out.append((row[0], thread, *row[1:]))
    return sorted(out, key=str)


def got(frame):
    assert all(r.rendered == f"<|{r.role or 'unknown'}|>\n{r.body}\n" for r in frame.collect())
    return sorted((tuple(r) for r in frame.drop("rendered").collect()), key=str)


def frame(spark, messages):
    return spark.createDataFrame([(*m, "x") for m in messages], MESSAGES)


@pytest.mark.parametrize("span", [2, 1000])
def test_equals_plain(spark, span):
    rng = random.Random(span)
    sentences = [f"This is sentence number {i} of them." for i in range(12)] + ["Yes.", "No way, never."]
    messages = []
    for conv in range(6):
        texts = []
        for turn in range(rng.randint(1, 14)):
            own = [rng.choice(sentences) for _ in range(rng.randint(1, 3))]
            text = rng.choice(["\n", "\n\n"]).join(own)
            if texts and rng.random() < 0.7:
                quoted = "\n".join("> " + x if not x.startswith(">") else ">" + x for x in rng.choice(texts).split("\n"))
                text = rng.choice(["On Monday X wrote:\n", ""]) + quoted + "\n" + text
            texts.append(text)
            messages.append((conv, turn, rng.choice(["user", "assistant", None]), text))
    assert got(Q.formatted(frame(spark, messages), span)) == plain(messages)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(m) for m in messages])
    assert compare(Q.formatted(frame(spark, messages), span), con, ORACLE["op3_quotation_linking"]) is None


def test_nested_levels_and_rewrapped_quotes(spark):
    messages = [
        (1, 0, "a", "The first message\nhas two lines."), (1, 1, "b", "A second one that says more."),
        (1, 2, "a", "> > The first message has\n> > two lines.\n> A second one that says more.\nReply to the second."),
        (1, 3, "b", ">> the FIRST message, has two lines\nReply to the first."),
        (1, 4, "a", "On Tuesday b wrote:\n> Reply to the second.\n\n> Reply to the first.\nTo the former."),
        (2, 9, "a", "> The first message has two lines.\nElsewhere.")]
    rows = {(r.conv_id, r.turn): r for r in Q.formatted(frame(spark, messages)).collect()}
    assert [rows[1, t].reply_to for t in range(5)] == [None, None, 1, 0, 3]
    assert [rows[1, t].thread for t in range(5)] == [0, 1, 1, 0, 0]
    assert rows[1, 2].n_passages == 2 and rows[1, 2].n_linked == 2 and rows[1, 2].quote_depth == 2
    assert rows[1, 4].body == "To the former." and rows[2, 9].reply_to is None


def test_short_and_rewrapped_quotes(spark):
    messages = [
        (1, 0, "a", "Shall we go?\nYes.\nThen bring the map with you."),
        (1, 1, "b", "The first sentence is here. The second one runs over\nmore than a line of text. A third one\nends the paragraph."),
        (1, 2, "a", "> Yes.\nGood."), (1, 3, "a", "> The second one runs\n> over more than a line\n> of text.\nIndeed."),
        (1, 4, "b", "> runs over\n> more than a line of\nOnly a part."), (1, 5, "b", "> the map\nNo line, no sentence."),
        (1, 6, "a", "> 一つ目の文です。\nno"), (2, 0, "a", "一つ目の文です。二つ目の文です。"), (2, 1, "b", "> 二つ目の文です。\nok")]
    rows = {(r.conv_id, r.turn): r.reply_to for r in Q.formatted(frame(spark, messages)).collect()}
    assert [rows[1, t] for t in range(7)] == [None, None, 0, 1, None, None, None] and rows[2, 1] == 0
    assert got(Q.formatted(frame(spark, messages))) == plain(messages)


def test_odd_rows(spark):
    long = "\n".join(f"Line number {i} of many lines" for i in range(3000))
    messages = [(1, 0, "a", None), (1, 1, None, ""), (1, 2, "a", ">"), (1, 3, "a", "> \n>\n"), (None, 0, "a", "null conversation here"),
                (None, 1, "a", "> null conversation here"), (1, None, "a", "> null turn\nx"), (2, 0, "u", long), (2, 1, "u", long),
                (2, 5, "u", "\n".join("> " + x for x in long.split("\n")) + "\r\nindeed"), (2, 5, "u", "> Line number 3 of many lines"),
                (2, 5, "u", "> Line number 3 of many lines")]
    assert got(Q.formatted(frame(spark, messages))) == plain(messages)
    assert Q.formatted(frame(spark, [])).count() == 0


def test_query_keeps_every_message(spark):
    sf = "/root/testdata/sf0.001"
    messages = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op3_quotation_linking"](spark, sf)
    assert got(found) == plain(messages)
    assert compare(found, connect(sf), ORACLE["op3_quotation_linking"]) is None
