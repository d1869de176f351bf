"""Secret scans over an incremental ledger of blobs, in DataFrame functions alone.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a table in the shared
folder with one row per (blob, rule, rule version) that was ever scanned, and the spans found. A
scan looks only at the pairs the ledger lacks, reads one copy of each such blob, appends what it
finds in one commit, and joins the ledger back to all paths.

A rule's matches are leftmost and don't overlap; those whose group is too short are dropped. Spans
are in code points, end exclusive. Positions come from the lengths of the pieces between the matches, summed
up in a window over the matches of one text, so that a text with very many matches costs no more than
its share.

Defined results: null text is empty and has no spans; repeated rows and copies are scanned once and reported for
each path; an empty table appends nothing; a null path is reported like any other; other columns of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.frames import joined, text_or_empty
from lectern.plans.sizing import broadcast_within, staged
from lectern.settings import BROADCAST_BYTES


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern, the group whose length counts, its least length, a version to raise on change."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "1"


# The base kinds, in the order in which spans of equal start are listed. Where the whole match is
# measured, the least length stands in the pattern: the matches are the same, as runs are maximal.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
LEDGER = "blob binary, rule string, rule_version string, spans array<struct<begin: int, until: int>>"
FOUND = "array<struct<begin: int, rank: int, kind: string, until: int>>"
MASK = "[SECRET]"
HOT_COPIES = 100_000


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; an empty one where there is no such folder yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def _current(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    wanted = [(F.col("rule") == r.kind) & (F.col("rule_version") == r.version) for r in rules]
    return ledger.where(reduce(lambda a, b: a | b, wanted))


def _rank(rules: Sequence[Rule]) -> Column:
    """Place of ``rule`` among ``rules``."""
    return F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule")).cast("int") - 1


def _matches(rule: Rule, text: Column) -> Column:
    """Lengths of the piece before each match, of the match and of its group; empty if there is none."""
    pattern = F.lit(rule.pattern)

    def lengths(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.length(p))

    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    group = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else whole
    before = lengths(F.split(text, rule.pattern, -1))
    zipped = F.arrays_zip(F.slice(before, F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"),
                          group.alias("group"))
    kind = "array<struct<before: int, whole: int, group: int>>"
    return F.when(text.rlike(rule.pattern), zipped.cast(kind)).otherwise(F.array().cast(kind))


def scan_new(versions: DataFrame, paths: DataFrame, ledger_path: str, rules: Sequence[Rule], path: str, text: str) -> None:
    """Append the spans of every pair of blob and rule version in ``paths`` that the ledger lacks."""
    spark = versions.sparkSession
    everything = (1 << len(rules)) - 1
    seen = (
        _current(read_ledger(spark, ledger_path), rules)
        .groupBy("blob").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), _rank(rules))).alias("seen"))
    )
    pending = (
        paths.groupBy("blob").agg(F.min("path").alias("path"))
        .join(seen, "blob", "left")
        .withColumn("todo", F.lit(everything).bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0)))))
        .where("todo <> 0").select("path", "blob", "todo")
    )
    texts = joined(
        versions.select(F.col(path).alias("path"), text_or_empty(text).alias("text"), _blob(text).alias("blob")),
        pending.hint("shuffle_hash"), ["path", "blob"], "inner")
    each = F.array(*[
        F.struct(
            F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), F.lit(r.least).alias("least"),
            F.when(F.col("todo").bitwiseAND(F.lit(1 << i)) != 0, _matches(r, F.col("text"))).alias("matches"))
        for i, r in enumerate(rules)
    ])
    # one copy of a blob may stand in repeated rows of a path: each row is worked out by itself, then one stays
    scanned = staged(
        texts.select(F.monotonically_increasing_id().alias("row"), "blob", F.inline(each)).where("matches is not null"),
        "scanned")
    so_far = W.partitionBy("row", "rule").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        scanned.where(F.size("matches") > 0)
        .select("row", "blob", "rule", "rule_version", "least", F.posexplode("matches").alias("at", "m"))
        .withColumn("until", F.sum(F.col("m.before") + F.col("m.whole")).over(so_far).cast("int"))
        .withColumn("span", F.when(
            F.col("m.group") >= F.col("least"), F.struct((F.col("until") - F.col("m.whole")).alias("begin"), "until")))
        .groupBy("row", "blob", "rule", "rule_version").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    )
    without = scanned.where(F.size("matches") == 0).select(
        "row", "blob", "rule", "rule_version", F.array().cast("array<struct<begin: int, until: int>>").alias("spans"))
    (
        placed.unionByName(without)
        .groupBy("blob", "rule", "rule_version").agg(F.min("spans").alias("spans"))
        .write.mode("append").parquet(ledger_path)
    )


def blob_spans(spark: SparkSession, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans) of blobs with secrets; spans by begin, then rule.

    A pair of blob and rule version may stand in the ledger twice, as when two scans run at once or a commit is
    repeated; its spans are the same each time and count once.
    """
    return (
        _current(read_ledger(spark, ledger_path), rules).where(F.size("spans") > 0)
        .groupBy("blob", "rule", "rule_version").agg(F.min("spans").alias("spans"))
        .select("blob", F.col("rule").alias("kind"), _rank(rules).alias("rank"), F.explode("spans").alias("s"))
        .groupBy("blob").agg(F.sort_array(F.collect_list(
            F.struct("s.begin", "rank", "kind", "s.until"))).cast(FOUND).alias("spans"))
    )


def scan(versions: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES, path: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(path, blob, spans) of every row of ``versions``, after its unseen blobs were scanned."""
    paths = staged(versions.select(F.col(path).alias("path"), _blob(text).alias("blob")), "paths")
    scan_new(versions, paths, ledger_path, rules, path, text)
    found = staged(blob_spans(versions.sparkSession, ledger_path, rules), "found")
    return _with_spans(paths, found, paths).select(
        F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(FOUND)).alias("spans"))


def _with_spans(rows: DataFrame, found: DataFrame, paths: DataFrame, limit: int = BROADCAST_BYTES, hot: int = HOT_COPIES) -> DataFrame:
    """``rows`` with the spans of their blob, or null.

    ``found`` is broadcast while it is small. Beyond, only the blobs with over ``hot`` of ``paths`` are, of which
    there are at most the number of rows by ``hot``; the rest is shuffled, and no key has more rows than that.
    """
    size = found.agg(F.count("*"), F.sum(F.size("spans"))).first()
    n = size[0] + (size[1] or 0)  # a span takes less than a row is reckoned with
    if n * 64 <= limit:
        return rows.join(F.broadcast(found), "blob", "left")
    copies = paths.groupBy("blob").count().where(F.col("count") > hot).select("blob")
    common = staged(copies.join(found, "blob", "left"), "common")
    size = common.agg(F.count("*"), F.sum(F.coalesce(F.size("spans"), F.lit(0)))).first()
    common = broadcast_within(common, size[0] + (size[1] or 0), 64)
    rest = rows.join(common.select("blob"), "blob", "left_anti")
    return rows.join(common, "blob").unionByName(rest.join(found, "blob", "left"))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with every span, or run of overlapping ones, replaced by MASK."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["begin"] - done["at"])
        longer = F.struct(F.concat(done["out"], gap, F.lit(MASK)).alias("out"), s["until"].alias("at"))
        covered = F.struct(done["out"].alias("out"), F.greatest(done["at"], s["until"]).alias("at"))
        return F.when((s["begin"] >= done["at"]), longer).otherwise(covered)

    return F.aggregate(spans, start, step, lambda done: F.concat(
        done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES, path: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``docs`` with its secrets masked; all rows and columns stay, texts without secrets unchanged (null too)."""
    spark = docs.sparkSession
    paths = staged(docs.select(F.col(path).alias("path"), _blob(text).alias("blob")), "paths")
    scan_new(docs, paths, ledger_path, rules, path, text)
    found = staged(blob_spans(spark, ledger_path, rules), "found")
    rows = docs.select(_blob(text).alias("blob"), F.struct("*").alias("row"))
    marked = _with_spans(rows, found, paths).select("row.*", F.col("spans").alias("__spans"))
    return marked.withColumn(
        text, F.when(F.col("__spans").isNotNull(), _masked(F.col(text), F.col("__spans"))).otherwise(F.col(text)),
    ).drop("__spans")
