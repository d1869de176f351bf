"""Chat formatting by quotation linking, in DataFrame functions alone.

Lines that begin with one or more ``>`` are quotes of that level; neighbouring lines of one level are a
passage. A passage, its paragraphs, and its lines and sentences of ``LINE_WORDS`` words or more are normalised (words of
letters and digits, lower case) and hashed; so are the own words of every message, with short lines and sentences, too:
a passage that is no more than one of these (``> Yes.``) is looked up whole. Sentences may run over lines, so a part
of a paragraph that was wrapped anew is found by them; less than a sentence or line is not. A unit links to the latest
earlier message of the conversation that has it. A message replies to what its outermost linked passage quotes; whole
passages count before paragraphs, these before lines, these before sentences, then later messages first. A thread is named by the message its
replies lead back to, and a conversation in reply order is ordered by thread, then turn: a
message without a linked quote begins a thread, so without quotes the order of turns stays.

The latest earlier message is found without pairing quotes and originals: both are laid along the turns of
a (conversation, unit), in spans of ``SPAN`` turns, so that a line that a long conversation repeats is spread over
many groups; what earlier spans end with is carried over from one row per span.

Defined results: null text is an empty body; a line that only tells who wrote the quote below it is left out; repeated rows are
reported each; equal turns do not quote each other; null conversations or turns link to nothing; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.frames import joined
from lectern.plans.sizing import staged

QUOTE = r"^\s{0,3}(?:>\s?)+"
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$"
WORD = r"[^\p{L}\p{N}]+"
SENTENCE = r"\n\s*\n|[.!?…]+[ \t\r\n]+|[。！？]+"
LINE_WORDS = 3
SPAN = 1000
KEY = ("conv_id", "turn", "mark")


def _lines(text: Column) -> Column:
    """(depth, body) of every line."""
    def line(raw: Column) -> Column:
        mark = F.regexp_extract(raw, QUOTE, 0)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("depth"),
                        F.regexp_replace(raw, QUOTE, "").alias("body"))

    return F.transform(F.split(text, r"\r?\n", -1), line)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), WORD, " "))


def _units(text: Column, least: int = 1) -> Column:
    """(kind, unit) of a passage: 0 the whole, 1 paragraphs, 2 lines and 3 sentences of ``least`` words or more."""
    def kind(parts: Column, number: int) -> Column:
        return F.transform(parts, lambda p: F.struct(F.lit(number).alias("kind"), _normal(p).alias("unit")))

    small = F.concat(kind(F.split(text, "\n", -1), 2), kind(F.split(text, SENTENCE, -1), 3))
    if least > 1:
        small = F.filter(small, lambda u: F.size(F.split(u["unit"], " ")) >= least)
    every = F.concat(kind(F.array(text), 0), kind(F.split(text, r"\n\s*\n", -1), 1), small)
    return F.filter(every, lambda u: u["unit"] != "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, mark (hash of the text), lines, body (own words) and quote_depth of every row."""
    text = F.coalesce("text", F.lit(""))
    own = F.filter(
        F.transform("lines", lambda x, i: F.struct(
            x["body"].alias("body"),
            ((x["depth"] == 0) & ~(x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get("lines", i + 1)["depth"], F.lit(0)) > 0))).alias("own"))),
        lambda x: x["own"])
    return (
        messages.select("conv_id", "turn", "role", F.xxhash64("text").alias("mark"), _lines(text).alias("lines"))
        .withColumn("body", F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")))
        .withColumn("quote_depth", F.array_max(F.transform("lines", lambda x: x["depth"])))
    )


def _passages(rows: DataFrame) -> DataFrame:
    """KEY, passage, depth and text of every quoted passage; a message is one group."""
    along = W.partitionBy(*KEY).orderBy("at")
    lines = (
        rows.where("quote_depth > 0").dropDuplicates(list(KEY))
        .select(*KEY, F.posexplode("lines").alias("at", "line")).select(*KEY, "at", "line.depth", "line.body")
        .withColumn("begins", (F.col("depth") != F.coalesce(F.lag("depth").over(along), F.lit(-1))).cast("int"))
        .withColumn("passage", F.sum("begins").over(along))
        .where("depth > 0")
    )
    texts = F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"])
    return lines.groupBy(*KEY, "passage", "depth").agg(F.array_join(texts, "\n").alias("text"))


def _latest_before(quoted: DataFrame, originals: DataFrame, span: int) -> DataFrame:
    """``quoted`` (conv_id, h, turn, ...) with ``source``: the last turn before it in ``originals`` (conv_id, h, turn)."""
    part = F.floor(F.col("turn") / span)
    asked = quoted.select("conv_id", "h", "turn").distinct()
    events = asked.withColumn("has", F.lit(0)).unionByName(originals.withColumn("has", F.lit(1))).withColumn("part", part)
    before = W.partitionBy("conv_id", "h", "part").orderBy("turn", "has").rowsBetween(W.unboundedPreceding, -1)
    inside = events.withColumn("near", F.max(F.when(F.col("has") == 1, F.col("turn"))).over(before)).where("has = 0")
    ends = originals.withColumn("part", part).groupBy("conv_id", "h", "part").agg(F.max("turn").alias("last"))
    spans = ends.withColumn("has", F.lit(1)).unionByName(
        inside.where("near IS NULL").select("conv_id", "h", "part").distinct().withColumns({"last": F.lit(None).cast("long"), "has": F.lit(0)}))
    earlier = W.partitionBy("conv_id", "h").orderBy("part").rangeBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.max("last").over(earlier)).where("has = 0").select("conv_id", "h", "part", "far")
    found = inside.join(carried, ["conv_id", "h", "part"], "left").select(
        "conv_id", "h", "turn", F.coalesce("near", "far").alias("source"))
    return quoted.join(found.where("source IS NOT NULL"), ["conv_id", "h", "turn"])


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread) of every replying turn: the turn at the end of its chain, by doubling steps."""
    known = staged(replies.select("conv_id", "turn", F.col("reply_to").alias("thread")), "threads")
    while True:
        step = known.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"))
        longer = staged(known.join(step, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")), "threads")
        known = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return known


def linked(messages: DataFrame, span: int = SPAN) -> DataFrame:
    """(KEY, n_passages, n_linked, reply_to) of every message with quotes."""
    rows = parsed(messages.select("conv_id", "turn", "role", "text").where("text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL"))
    passages = staged(_passages(rows), "passages")
    digest = F.struct(F.xxhash64("u.unit"), F.hash("u.unit"))
    quoted = staged(passages.select(*KEY, "passage", "depth", F.explode(_units(F.col("text"), LINE_WORDS)).alias("u"))
                    .select(*KEY, "passage", "depth", "u.kind", digest.alias("h")), "quoted")
    wanted = quoted.select("conv_id", "h").distinct()
    originals = (
        rows.select("conv_id", "turn", F.explode(_units(F.col("body"))).alias("u"))
        .select("conv_id", "turn", digest.alias("h")).join(wanted, ["conv_id", "h"], "left_semi").distinct())
    links = _latest_before(quoted, staged(originals, "originals"), span)
    best = F.min(F.struct("depth", "kind", (-F.col("source")).alias("turn")))
    replies = links.groupBy(*KEY).agg(best.alias("best"), F.countDistinct("passage").alias("n_linked"))
    return passages.groupBy(*KEY).agg(F.count("*").alias("n_passages")).join(replies, list(KEY), "left").select(
        *KEY, "n_passages", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), (-F.col("best.turn")).alias("reply_to"))


def formatted(messages: DataFrame, span: int = SPAN) -> DataFrame:
    """Every message without its quotes: conv_id, thread, turn, role, body, rendered, quote_depth, n_passages, n_linked, reply_to.

    Rows in the order of (conv_id, thread, turn) are the conversations in reply order.
    """
    links = staged(linked(messages, span), "replies")
    # turns that two messages share reply where the earlier of their sources is
    replies = links.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to"))
    threads = _threads(replies)
    rows = parsed(messages).drop("lines")
    found = joined(rows, links, list(KEY), "left")
    found = joined(found, threads, ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("unknown"))
    return found.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "body",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("body"), F.lit("\n")).alias("rendered"),
        F.col("quote_depth").cast("long").alias("quote_depth"),
        F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "reply_to")
