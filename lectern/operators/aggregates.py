"""Value counts, facets, shares and completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators.bitmaps import ValueIndex, value_counts
from lectern.operators.filters import apply_filters, clean, filter_key, match_filters
from lectern.plans.sizing import broadcast_within, staged, top_per_group
from lectern.settings import DEFAULT_BUCKETS, FACET_LIMITS, QUESTION_BUCKETS


def _counts(df: DataFrame, field: str) -> DataFrame:
    value = F.col(field).cast("string")
    return df.where(F.col(field).isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def terms_agg(
    corpus: DataFrame,
    field: str,
    max_buckets: int = DEFAULT_BUCKETS,
    filters: Mapping[str, str] | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Values of ``field`` with their document counts: ``value, count, rk``, most frequent first, ties by value."""
    count = F.asc("count") if ascending else F.desc("count")
    order = [count, F.asc("value")]
    top = _counts(apply_filters(corpus, filters), field).orderBy(*order).limit(max_buckets)
    # at most max_buckets rows are left to number
    return top.withColumn("rk", F.row_number().over(W.orderBy(*order)))


def completeness(distinct: Column, max_buckets: Column) -> list[Column]:
    """``total_unique, returned, is_complete, is_exact_complete, notes`` for a capped value list.

    ``is_complete`` is false when the list is exactly full, as documented;
    ``is_exact_complete`` says whether a value is really missing.
    """
    returned = F.least(distinct, max_buckets.cast("bigint"))
    note = F.format_string("Showing top %d of %d values.", returned, distinct)
    return [
        distinct.alias("total_unique"),
        returned.alias("returned"),
        (returned < max_buckets).alias("is_complete"),
        (returned == distinct).alias("is_exact_complete"),
        F.when(returned < max_buckets, F.array().cast("array<string>")).otherwise(F.array(note)).alias("notes"),
    ]


def distinct_count(
    corpus: DataFrame,
    fields: Sequence[str],
    filters: Mapping[str, str] | None = None,
    approximate: bool = False,
    rsd: float = 0.01,
) -> DataFrame:
    """Number of distinct values per field: ``field, total_unique``.

    Exact counts of several fields are taken in one scan in long form, so that a
    value is counted where it is hashed to and no task holds a field's values.
    """
    docs = apply_filters(corpus, filters)
    if approximate:
        one = docs.agg(*[F.approx_count_distinct(f, rsd).alias(f) for f in fields])
        return one.select(_long_form(fields)).select("c.field", F.col("c.value").cast("bigint").alias("total_unique"))
    values = docs.select(_long_form(fields)).where("c.value is not null").select("c.field", "c.value").distinct()
    found = values.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    names = docs.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return names.join(found, "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("total_unique"))


def _long_form(fields: Sequence[str]) -> Column:
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    return F.explode(F.array(*pairs)).alias("c")


def multi_terms_agg(
    corpus: DataFrame,
    limits: Mapping[str, int] | Sequence[str],
    filters: Mapping[str, str] | None = None,
    index: ValueIndex | None = None,
) -> DataFrame:
    """Value counts of several fields in one scan: ``field, value, count, rk, total_unique, returned, is_complete``.

    With an ``index`` that has the fields, the documents aren't read.
    """
    if not isinstance(limits, Mapping):
        limits = {f: DEFAULT_BUCKETS for f in limits}
    if index is not None:
        one = [("all", dict(filters or {}), list(limits))]
        specs = corpus.sparkSession.createDataFrame(one, "spec string, filters map<string,string>, fields array<string>")
        counts = value_counts(index, specs.withColumn("filters", clean(F.col("filters")))).drop("spec")
    else:
        counts = (
            apply_filters(corpus, filters)
            .select(_long_form(list(limits)))
            .where("c.value is not null")
            .groupBy("c.field", "c.value")
            .agg(F.count(F.lit(1)).alias("count"))
        )
    cap = F.create_map(*[x for f, n in limits.items() for x in (F.lit(f), F.lit(n))])
    # counted through the count column: with the same columns as the ranking, both share one scan
    totals = counts.groupBy("field").agg(F.count_if(F.col("count") > 0).alias("distinct"))
    order = [F.desc("count"), F.asc("value")]
    ranked = top_per_group(counts, ["field"], order, max(limits.values()), spread_on=["value"])
    ranked = ranked.withColumn("cap", cap[F.col("field")]).where(F.col("rk") <= F.col("cap"))
    return ranked.join(broadcast_within(totals, len(limits)), "field").select(
        "field", "value", "count", "rk", *completeness(F.col("distinct"), F.col("cap"))[:3]
    )


def facets(
    corpus: DataFrame,
    limits: Mapping[str, int] = FACET_LIMITS,
    filters: Mapping[str, str] | None = None,
    index: ValueIndex | None = None,
) -> DataFrame:
    """Values on offer per field, most frequent first: ``field, options``."""
    listed = multi_terms_agg(corpus, limits, filters, index)
    return listed.groupBy("field").agg(_ordered("rk", F.col("value")).alias("options"))


def _ordered(rank: str, item: Column) -> Column:
    """Items of a group as an array in rank order (for groups of bounded size)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), item.alias("x"))))
    return F.transform(pairs, lambda p: p["x"])


def distribution(
    corpus: DataFrame,
    field: str,
    max_buckets: int = QUESTION_BUCKETS,
    filters: Mapping[str, str] | None = None,
) -> DataFrame:
    """Value counts with each value's share in percent of all counted documents."""
    counts = _counts(apply_filters(corpus, filters), field)
    total = counts.agg(F.sum("count")).scalar()
    order = [F.desc("count"), F.asc("value")]
    top = counts.withColumn("total", total).orderBy(*order).limit(max_buckets)
    return top.select(
        "value", "count",
        F.round(F.try_divide(F.col("count") * 100.0, F.col("total")), 4).alias("percent"),
        F.row_number().over(W.orderBy(*order)).alias("rk"),
    )


def coverage_percent(is_complete: Column, returned: Column, total_unique: Column) -> Column:
    """How much of the value list is shown; a partial list never reads more than 95."""
    share = F.coalesce(F.try_divide(returned * 100.0, total_unique), F.lit(0.0))
    return F.when(is_complete, F.lit(100.0)).otherwise(F.bround(F.least(share, F.lit(95.0)), 0))


# --- value lists for a table of questions ---------------------------------

def terms_for_questions(
    corpus: DataFrame,
    asks: DataFrame,
    max_buckets: int = QUESTION_BUCKETS,
    fields: Sequence[str] | None = None,
    index: ValueIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Value lists for many questions in one pass over the corpus.

    ``asks`` has ``qid, enum_field, filters``. Questions with the same field and
    filters share one list. Returns the lists, ``spec, field, value, count, rk``,
    with their summaries, ``spec, field, total, total_unique, returned,
    is_complete, is_exact_complete, notes``; join both to :func:`with_spec`.
    ``fields`` names the fields asked for, where they are known. With an ``index`` of them and of the filters' fields the
    corpus isn't read.
    """
    wanted = with_spec(asks).groupBy("spec").agg(
        F.any_value(clean(F.col("filters"))).alias("filters"),
        F.array_sort(F.collect_set("enum_field")).alias("fields"),
    )
    if fields is None:
        fields = sorted(r[0] for r in asks.select("enum_field").distinct().collect())
    for f in fields:
        corpus[f]  # an unknown column fails here
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(f).cast("string")) for f in fields], F.lit(None))
    if index is not None:
        counts = value_counts(index, wanted)
    else:
        counts = (
            match_filters(corpus, wanted, carry=["fields"])
            .withColumn("field", F.explode("fields"))
            .select("spec", "field", value.alias("value"))
            .where("value is not null")
            .groupBy("spec", "field", "value")
            .agg(F.count(F.lit(1)).alias("count"))
        )
    # lists and summaries are often written or joined apart; the corpus is read once for both
    counts = staged(counts, "counts")
    order = [F.desc("count"), F.asc("value")]
    lists = top_per_group(counts, ["spec", "field"], order, max_buckets, spread_on=["value"])
    found = counts.groupBy("spec", "field").agg(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("distinct")
    )
    every = wanted.select("spec", F.explode("fields").alias("field"))
    summaries = every.join(found, ["spec", "field"], "left").select(
        "spec", "field", F.coalesce("total", F.lit(0)).alias("total"),
        *completeness(F.coalesce("distinct", F.lit(0)), F.lit(max_buckets)),
    )
    return lists, summaries


def with_spec(asks: DataFrame) -> DataFrame:
    """Questions with the ``spec`` key of their cleaned filters."""
    return asks.withColumn("spec", filter_key(clean(F.col("filters"))))


# --- value lists as text ---------------------------------------------------

def context_line(rank: Column, value: Column, count: Column) -> Column:
    label = F.when(count > 1, F.format_string("(%d documents)", count)).otherwise(F.lit("(1 document)"))
    return F.format_string("  %d. %s %s", rank, value, label)


def report_line(rank: Column, value: Column, count: Column) -> Column:
    label = F.when(count > 1, F.format_string(" — %d documents", count)).otherwise(F.lit(" — 1 document"))
    return F.format_string("%d. **%s**%s", rank, value, label)


def share_line(rank: Column, value: Column, count: Column, total: Column) -> Column:
    """:func:`context_line` with the value's share worked out."""
    percent = F.format_string(" %.2f%%", F.coalesce(F.try_divide(count * 100.0, total), F.lit(0.0)))
    return F.concat(context_line(rank, value, count), percent)


def value_text(lists: DataFrame, keys: Sequence[str], line: Column) -> DataFrame:
    """One text per value list, lines in rank order. Lists are capped, so groups are small."""
    return lists.groupBy(*keys).agg(F.array_join(_ordered("rk", line), "\n").alias("lines"))


def agg_context(field: Column, lines: Column, total_unique: Column, returned: Column, is_complete: Column) -> Column:
    """Value list as prompt text."""
    head = F.format_string("Complete list of %d distinct %s values found in the index:\n", total_unique, field)
    note = F.format_string(
        "\n[NOTE: Showing top %d of %d total unique values. List may be incomplete.]", returned, total_unique
    )
    return F.concat_ws("\n", head, F.when(lines != "", lines), F.when(~is_complete, note))


def enumeration_answer(
    field: Column,
    lines: Column,
    total_unique: Column,
    returned: Column,
    is_complete: Column,
    notes: Column,
    total_docs: Column,
    index_name: Column,
    source_lines: Column | None = None,
    source_count: Column | None = None,
) -> Column:
    """Value list as a finished answer."""
    parts = [
        F.concat(F.lit("## Complete List of "), field, F.lit("\n")),
        F.format_string("**Total: %d distinct values**\n", total_unique),
        F.when(lines != "", lines),
        F.when(
            ~is_complete,
            F.format_string(
                "\n⚠ Showing top %d of %d total values. Some values may be missing.", returned, total_unique
            ),
        ),
        F.when(
            F.size(notes) > 0,
            F.concat(
                F.lit("\n## Data Quality Notes\n\n"),
                F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n"),
            ),
        ),
        F.when(total_docs > 0, F.format_string("\n_Searched %,d documents in index '%s'_", total_docs, index_name)),
    ]
    if source_lines is not None:
        head = F.format_string("\n## Supporting Sources (%d documents sampled)\n\n", source_count)
        parts.append(F.when(source_lines != "", F.concat(head, source_lines)))
    return F.concat_ws("\n", *parts)
