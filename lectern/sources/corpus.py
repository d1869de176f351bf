"""Document tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import embedding_text
from lectern.settings import EMBED_FIELDS, KNOWN_FIELDS, PREVIEW_CHARS


def load_corpus(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    id_col: str = "doc_id",
    columns: Mapping[str, str | Column] | None = None,
    fields: Sequence[str] = KNOWN_FIELDS,
) -> DataFrame:
    """Documents as ``doc_id`` and string columns, the rest as JSON in ``extra``.

    JSON documents are read as they come: a known field keeps its value only where it
    is a JSON string, and every other property stays in ``extra``. Tables with a schema
    are taken as they are, or mapped with ``columns`` (field -> column name or expression).
    """
    if format in ("json", "jsonl"):
        return _json_corpus(spark, path, id_col, fields)
    df = spark.read.format(format).load(path)
    if columns is None:
        return df
    picked = [(F.col(c) if isinstance(c, str) else c).alias(f) for f, c in columns.items()]
    return df.select(F.col(id_col).alias("doc_id"), *picked)


def _json_corpus(spark: SparkSession, path: str, id_col: str, fields: Sequence[str]) -> DataFrame:
    doc = F.try_parse_json(F.col("value"))
    raw = spark.read.text(path).where(F.trim("value") != "").select(doc.alias("doc"))

    def text_only(field: str) -> Column:
        # schema_of_variant tells a JSON string from a number, list or object
        part = F.try_variant_get("doc", f"$.{field}", "variant")
        is_text = F.schema_of_variant(part) == "STRING"
        return F.when(is_text, F.try_variant_get("doc", f"$.{field}", "string")).alias(field)

    props = F.try_variant_get("doc", "$", "map<string,variant>")
    known = set(fields)
    extra = F.map_filter(
        props, lambda k, v: (k != id_col) & (~k.isin(*known) | (F.schema_of_variant(v) != "STRING"))
    )
    extra = F.transform_values(extra, lambda _, v: F.to_json(v))
    doc_id = F.try_variant_get("doc", f"$.{id_col}", "string").alias("doc_id")
    return raw.select(doc_id, *[text_only(f) for f in fields], extra.alias("extra"))


def corpus_count(corpus: DataFrame) -> int:
    return corpus.count()


def preview_text(corpus: DataFrame, n: int = 3, id_col: str = "doc_id", fields=EMBED_FIELDS) -> DataFrame:
    """Length and start of the embedding text of the first ``n`` documents."""
    text = embedding_text(corpus, fields)
    return (
        corpus.select(F.col(id_col), text.alias("text"))
        .orderBy(id_col).limit(n)
        .select(
            F.col(id_col).alias("doc_id"),
            F.length("text").alias("text_chars"),
            F.left("text", F.lit(PREVIEW_CHARS)).alias("preview"),
        )
    )
