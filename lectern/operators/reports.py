"""One report record per question."""

from __future__ import annotations

from time import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.hits import CITATION
from lectern.rules import COUNTING_INTENTS, DEFAULT_MODE, MODES
from lectern.settings import TITLE_QUERY_CHARS

NO_HITS = "No relevant documents found in the index. Try a different query or broader terms."

METADATA = (
    "struct<total_hits:bigint,deduplicated_hits:bigint,selected_hits:bigint,context_chars:bigint,"
    "generation_time:double,timestamp:timestamp,model:string,embed_model:string,index:string,"
    "index_total_docs:bigint,strategy:string,intent:string,is_enumeration:boolean,enumeration_field:string,"
    "aggregation:struct<field:string,total_unique:bigint,returned_values:bigint,is_complete:boolean>,"
    "filters:map<string,string>>"
)
REPORT = (
    "qid {qid}, title string, mode string, mode_label string, mode_icon string, mode_color string, "
    f"query string, answer string, sources array<{CITATION}>, completeness_notes array<string>, "
    f"metadata {METADATA}"
)


def _mode(mode: Column, part: int) -> Column:
    pairs = [x for m, info in MODES.items() for x in (F.lit(m), F.lit(info[part]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mode), F.lit(MODES[DEFAULT_MODE][part]))


def report_title(mode: Column, query: Column, shorten_mark: Column | bool = True) -> Column:
    """``icon Label Report: query``, the query cut to 60 characters; empty reports have no dots."""
    dots = F.when((F.length(query) > TITLE_QUERY_CHARS) & F.lit(shorten_mark), F.lit("...")).otherwise(F.lit(""))
    return F.concat(
        _mode(mode, 1), F.lit(" "), _mode(mode, 0), F.lit(" Report: "), F.left(query, F.lit(TITLE_QUERY_CHARS)), dots
    )


def enumeration_title(field: Column, total_unique: Column) -> Column:
    return F.format_string("📋 Enumeration: %s (%d values)", field, total_unique)


def build_reports(
    answered: DataFrame,
    index_name: str,
    index_total_docs: int | Column,
    model: str,
    embed_model: str,
    started: float | None = None,
) -> DataFrame:
    """Report rows from answered questions.

    ``answered`` has ``qid, query, mode, filters, intent, enum_field, strategy, answer, sources, notes,
    total_hits, deduplicated_hits, context_chars, aggregation``. A null answer of a search strategy means
    that nothing was found.
    """
    direct = F.col("strategy") == "direct_aggregation"
    empty = F.col("answer").isNull()
    sources = F.coalesce("sources", F.array().cast(f"array<{CITATION}>"))
    title = F.when(direct, enumeration_title(F.col("enum_field"), F.col("aggregation.total_unique"))).otherwise(
        report_title(F.col("mode"), F.col("query"), ~empty)
    )
    elapsed = F.lit(round(time() - started, 1) if started is not None else 0.0)
    metadata = F.struct(
        F.coalesce("total_hits", F.lit(0)).cast("bigint").alias("total_hits"),
        F.coalesce("deduplicated_hits", F.lit(0)).cast("bigint").alias("deduplicated_hits"),
        F.size(sources).cast("bigint").alias("selected_hits"),
        F.coalesce("context_chars", F.lit(0)).cast("bigint").alias("context_chars"),
        elapsed.alias("generation_time"),
        F.current_timestamp().alias("timestamp"),
        F.when(direct, F.lit("direct-enumeration")).otherwise(F.lit(model)).alias("model"),
        F.lit(embed_model).alias("embed_model"),
        F.lit(index_name).alias("index"),
        (F.lit(index_total_docs) if isinstance(index_total_docs, int) else index_total_docs)
        .cast("bigint").alias("index_total_docs"),
        F.when(direct, F.lit("direct_enumeration")).otherwise(F.col("strategy")).alias("strategy"),
        F.col("intent"),
        F.col("intent").isin(*COUNTING_INTENTS).alias("is_enumeration"),
        F.col("enum_field").alias("enumeration_field"),
        F.col("aggregation"),
        F.col("filters"),
    ).cast(METADATA)
    return answered.select(
        "qid",
        title.alias("title"),
        F.when(direct, F.lit(DEFAULT_MODE)).otherwise(F.col("mode")).alias("mode"),
        F.when(direct, F.lit("Enumeration")).otherwise(_mode(F.col("mode"), 0)).alias("mode_label"),
        F.when(direct, F.lit("📋")).otherwise(_mode(F.col("mode"), 1)).alias("mode_icon"),
        F.when(direct, F.lit(MODES[DEFAULT_MODE][2])).otherwise(_mode(F.col("mode"), 2)).alias("mode_color"),
        "query",
        F.coalesce("answer", F.lit(NO_HITS)).alias("answer"),
        sources.alias("sources"),
        F.coalesce("notes", F.array().cast("array<string>")).alias("completeness_notes"),
        metadata.alias("metadata"),
    )
