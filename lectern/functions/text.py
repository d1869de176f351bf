"""Text expressions. Everything here stays a built-in Catalyst expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.settings import CONTEXT_FIELDS, EMBED_FIELDS, FALLBACK_CHARS

# What str.strip() removes; SQL trim alone only removes spaces.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def folded(col: Column) -> Column:
    """Lower case, no surrounding white space: the form keys are compared in."""
    return F.lower(strip(col))


def text_fields(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """The given fields that ``df`` has as strings; other types never count as text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [f for f in fields if isinstance(types.get(f), T.StringType)]


def first_present(df: DataFrame, fields: Sequence[str], default: str) -> Column:
    present = text_fields(df, fields)
    return F.coalesce(*[F.col(f) for f in present], F.lit(default))


def embedding_text(df: DataFrame, fields: Sequence[str] = EMBED_FIELDS) -> Column:
    """Non-blank values stripped, repeats dropped keeping the first, joined by a space."""
    cols = [strip(F.col(f)) for f in text_fields(df, fields)]
    if not cols:
        return F.lit("")
    kept = F.filter(F.array(*cols), lambda v: v != "")
    return F.array_join(F.array_distinct(kept), " ")


def passage(df: DataFrame, fields: Sequence[str] = CONTEXT_FIELDS) -> Column:
    """``name: value`` pairs joined by `` | ``, else the start of the embedded text."""
    pairs = [
        F.when(strip(F.col(f)) != "", F.concat(F.lit(f"{f}: "), strip(F.col(f))))
        for f in text_fields(df, fields)
    ]
    joined = F.concat_ws(" | ", *pairs) if pairs else F.lit("")
    if not text_fields(df, ["embedded_text"]):
        return joined
    fallback = F.coalesce(F.left(F.col("embedded_text"), F.lit(FALLBACK_CHARS)), F.lit(""))
    return F.when(joined != "", joined).otherwise(fallback)


def first_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Value of the first rule (value, pattern) found in ``text``; null if none is.

    Patterns read \\w, \\s, \\d and \\b over all of Unicode.
    """
    def add(chain, rule):
        value, pattern = rule
        hit = text.rlike(f"(?U){pattern}")
        return F.when(hit, value) if chain is None else chain.when(hit, value)

    return reduce(add, rules, None)


def entry(rank: Column, score: Column, body: Column) -> Column:
    return F.format_string("[Source %d] (score: %.4f)\n%s", rank, score, body)
