"""Field words of any number, as a table instead of a branch for each.

A question's runs of word characters are met with the rules by one join, so a plan is as small for 50,000 words as for ten.
The result is that of :func:`lectern.plans.route.field_of`: the first rule whose word or phrase stands in the question as a
whole word. A phrase has to stand there with the same characters between its words.

Equal questions are looked up once, and only the SHA-256 of their text goes on from there. Rules are broadcast while ``RULE_ROWS`` and ``RULE_BYTES`` hold; beyond, both sides are
salted, so that a word that most questions have is spread over many tasks. The way back to the questions is salted too, as
one question may be asked by a third of all rows.

Defined results: null and empty questions, and those without a rule's word, have a null field; so have all where the table of
rules is empty. Rules with a null, or whose words don't begin and end with a word character, are left out. Of rules of one place the
smaller column counts, of repeated ones the first. Words are compared folded: lower case, no surrounding white space.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import folded

RULE_ROWS = 500_000
RULE_BYTES = 32 << 20
SALTS = 16
RUNS = r"(?U)\w+|\W+"
WHOLE = r"(?U)^\w(?s:.*)(?<=\w)$"


def rule_table(questions: DataFrame, words: Mapping[str, str]) -> DataFrame:
    """(word, column, place) of rules given in order."""
    rows = [(word, column, place) for place, (word, column) in enumerate(words.items())]
    return questions.sparkSession.createDataFrame(rows, "word string, column string, place bigint")


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _salt(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salts)), F.lit(salts)).cast("int")


def first_fields(texts: DataFrame, rules: DataFrame, rule_rows: int = RULE_ROWS, rule_bytes: int = RULE_BYTES,
                 salts: int = SALTS) -> DataFrame:
    """(key, enum_field) of every one of the distinct folded ``texts`` (column ``text``) that has a rule's word."""
    known = (
        rules.select(folded(F.col("word")).alias("word"), F.struct(F.col("place").cast("bigint").alias("place"), "column").alias("rule"))
        .where(F.col("word").rlike(WHOLE) & F.col("rule.place").isNotNull() & F.col("rule.column").isNotNull())
        .groupBy("word").agg(F.min("rule").alias("rule"))
    )
    sizes = known.select(
        F.size(_runs(F.col("word"))).alias("runs"), (F.octet_length("word") + F.octet_length("rule.column") + 16).alias("bytes"))
    # one row per length of a phrase: a few, however many rules there are
    lengths = {r.runs: (r.rows, r.bytes) for r in
               sizes.groupBy("runs").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).collect()}
    if not lengths:
        return texts.select(_key(F.col("text")).alias("key"), F.lit(None).cast("string").alias("enum_field")).limit(0)
    runs = _runs(F.col("text"))
    pieces = [
        runs if n == 1 else
        F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size("runs") - (n - 1), F.lit(1))), lambda at: at + (n - 1) <= F.size("runs")),
            lambda at: F.array_join(F.slice("runs", at, n), ""))
        for n in sorted(lengths)
    ]
    words = texts.withColumn("runs", runs).select(_key(F.col("text")).alias("key"), F.explode(F.array_distinct(F.concat(*pieces))).alias("word"))
    if sum(r for r, _ in lengths.values()) <= rule_rows and sum(b for _, b in lengths.values()) <= rule_bytes:
        met = words.join(F.broadcast(known), "word")
    else:
        met = words.withColumn("__salt", _salt(F.col("key"), salts)).join(_salted(known, salts), ["word", "__salt"])
    return met.groupBy("key").agg(F.min("rule").alias("rule")).select("key", F.col("rule.column").alias("enum_field"))


def resolve_by_rules(questions: DataFrame, rules: DataFrame | Mapping[str, str], rule_rows: int = RULE_ROWS,
                     rule_bytes: int = RULE_BYTES, salts: int = SALTS) -> DataFrame:
    """``questions`` with ``enum_field`` by ``rules``: (word, column, place), the least place first, or words in order."""
    if isinstance(rules, Mapping):
        rules = rule_table(questions, rules)
    texts = questions.select(folded(F.col("query")).alias("text")).where("text <> ''").distinct()
    found = first_fields(texts, rules, rule_rows, rule_bytes, salts)
    # columns that can't be hashed don't help to spread equal questions
    spread = [f.name for f in questions.schema.fields if isinstance(f.dataType, T.AtomicType)]
    asked = questions.withColumns(
        {"__key": _key(folded(F.col("query"))), "__salt": _salt(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), salts)})
    back = _salted(found, salts).select(F.col("key").alias("__key"), "__salt", F.col("enum_field").alias("__field"))
    return asked.join(back, ["__key", "__salt"], "left").select(
        *[F.col(f"`{c}`") for c in questions.columns if c != "enum_field"], F.col("__field").alias("enum_field"))
