"""Which way each question is answered. Row-local: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import first_match, folded
from lectern.rules import DEFAULT_STRATEGY, FIELD_WORDS, INTENT_PATTERNS, STRATEGIES, field_patterns, intent_patterns


def intent_of(query: Column, cues=INTENT_PATTERNS) -> Column:
    return F.coalesce(first_match(folded(query), intent_patterns(cues)), F.lit("unknown"))


def field_of(query: Column, words=FIELD_WORDS) -> Column:
    return first_match(folded(query), field_patterns(words))


def classify_intent(questions: DataFrame, cues=INTENT_PATTERNS) -> DataFrame:
    return questions.withColumn("intent", intent_of(F.col("query"), cues))


def resolve_field(questions: DataFrame, words=FIELD_WORDS) -> DataFrame:
    return questions.withColumn("enum_field", field_of(F.col("query"), words))


def route(questions: DataFrame, cues=INTENT_PATTERNS, words=FIELD_WORDS) -> DataFrame:
    """Adds ``intent, enum_field, strategy, confidence``."""
    known = resolve_field(classify_intent(questions, cues), words)
    rules = [
        (
            F.col("intent").isin(*intents) & (F.col("enum_field").isNotNull() if needs_field else F.lit(True)),
            F.struct(F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence")),
        )
        for intents, needs_field, strategy, confidence in STRATEGIES
    ]
    strategy, confidence = DEFAULT_STRATEGY
    chosen = F.struct(F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence"))
    for condition, value in reversed(rules):
        chosen = F.when(condition, value).otherwise(chosen)
    return known.withColumn("__way", chosen).select("*", "__way.strategy", "__way.confidence").drop("__way")
