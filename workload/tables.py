"""The test tables in the shape the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lectern as L
from lectern.plans.sizing import spread_small

# Openings that turn a line of talk into a question of each kind.
OPENINGS = (
    "List all locations near", "How many sites hold", "Top 5 most frequent locations of",
    "Distribution of activity types for",
    "Analyze the tasks in", "Compare devices with", "Trend of events over", "Forecast for", "What is", "Search for",
    "Details about", "Give a recap of", "Latest", "Anything similar to", "List all equipment types of",
    "Summarize all activities of", "What are the key deployment activities of", "Predict maintenance needs of",
    "Which", "Show every form_title with", "Sources of", "small cats and", "", "Plans for", "tl;dr",
    "Status breakdown by category of", "explain", "Risk outlook", "today's", "regarding",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents: first line as title, text as description, source and lang as filterable fields."""
    return L.load_corpus(
        spark, f"{sf}/documents.parquet",
        columns={
            "title": F.regexp_extract("text", r"^[^\n]*", 0),
            "description": "text",
            "source_type": "source",
            "form_type": "lang",
        },
    )


def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_vectors(corpus(spark, sf))


def text_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per benchmark text."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"), F.lit("answer").alias("mode"),
        F.create_map().cast("map<string,string>").alias("filters"),
    )


def _opened(key, text):
    pick = F.pmod(key, F.lit(len(OPENINGS))).cast("int") + 1
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), pick)
    return F.concat(opening, F.lit(" "), text)


def opened_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark texts as questions of each kind."""
    return text_questions(spark, sf).withColumn("query", _opened(F.col("qid"), F.col("query")))


def vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per label: the mean of its vectors."""
    values = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = values.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pairs = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy(F.col("label").alias("qid")).agg(F.transform(pairs, lambda p: p["x"]).alias("vector"))


def talk_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per line of talk, opened in one of several ways."""
    query = _opened(F.col("conv_id") * 7 + F.col("turn"), F.col("text"))
    return spread_small(table(spark, sf, "conversations")).select(
        "conv_id", "turn", query.alias("query"), F.col("role").alias("mode"),
    )


def listing_questions(spark: SparkSession, sf: str) -> DataFrame:
    """List the sources of each language, one question per language."""
    langs = table(spark, sf, "documents").select("lang").distinct()
    return langs.select(
        F.col("lang").alias("qid"), F.lit("List all sources").alias("query"), F.lit("answer").alias("mode"),
        F.create_map(F.lit("form_type"), F.concat(F.lit(" "), F.col("lang"))).alias("filters"),
    )
