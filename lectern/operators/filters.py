"""Equality filters, for one question and for a table of questions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.plans.sizing import broadcast_within
from lectern.settings import FILTER_FIELDS, IN_LIST_VALUES


def clean(filters: Column) -> Column:
    """Values stripped, blank ones dropped."""
    stripped = F.transform_values(filters, lambda _, v: strip(v))
    kept = F.map_filter(stripped, lambda _, v: v.isNotNull() & (v != ""))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def accepted(filters: Column, fields: Sequence[str] = FILTER_FIELDS) -> Column:
    """Only the fields a question may filter on, cleaned."""
    return F.map_filter(clean(filters), lambda k, _: k.isin(*fields))


def parse_filters(items: Column) -> Column:
    """``field=value`` strings to a map: the first ``=`` splits, items without one are ignored, later ones win."""
    usable = F.filter(items, lambda s: F.contains(s, F.lit("=")))
    pairs = F.transform(
        usable,
        lambda s: F.struct(
            F.substring_index(s, "=", 1).alias("field"),
            F.substr(s, F.instr(s, "=") + 1).alias("value"),
        ),
    )
    # keep the last value of a repeated field
    later = lambda p, i: F.exists(
        F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["field"] == p["field"]
    )
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~later(p, i)))


def equals(df: DataFrame, field: str, value: str) -> Column:
    """``field`` holds exactly ``value``; the value takes the column's type so that it reaches the scan."""
    return F.col(field) == F.lit(value).try_cast(df.schema[field].dataType)


def as_predicate(df: DataFrame, filters: Mapping[str, str] | None) -> Column | None:
    wanted = {f: str(v).strip() for f, v in (filters or {}).items() if v and str(v).strip()}
    for f in wanted:
        df[f]  # an unknown column fails here
    terms = [equals(df, f, v) for f, v in wanted.items()]
    return reduce(lambda a, b: a & b, terms) if terms else None


def apply_filters(df: DataFrame, filters: Mapping[str, str] | None) -> DataFrame:
    """Conjunction of exact matches; blank values are ignored. Apply before ranking or grouping."""
    predicate = as_predicate(df, filters)
    return df if predicate is None else df.where(predicate)


def filter_key(filters: Column) -> Column:
    """Text that is equal for equal filter maps."""
    return F.to_json(F.array_sort(F.map_entries(filters)))


def match_filters(corpus: DataFrame, specs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Corpus rows once per filter map they satisfy, in one scan.

    ``specs`` has ``spec`` (the :func:`filter_key`), ``filters`` (cleaned) and the
    ``carry`` columns, one row per filter map. A row gets one key for each set of fields that maps
    name, and all keys meet the maps in one equality join, so the number of maps is not
    limited. The values of a short list also go to the scan as IN lists.
    """
    specs = specs.select("spec", "filters", *carry)
    head = specs.limit(IN_LIST_VALUES + 1).collect()
    short = len(head) <= IN_LIST_VALUES
    names = F.array_sort(F.map_keys("filters"))
    if short:
        sets = Counter(tuple(sorted(row["filters"])) for row in head)
    else:
        sets = {tuple(r[0]): r[1] for r in specs.groupBy(names).count().collect()}
    if not sets:
        empty = [F.lit(None).cast(specs.schema[c].dataType).alias(c) for c in ("spec", *carry)]
        return corpus.select("*", *empty).limit(0)
    shapes = sorted(sets)
    docs = corpus.where(_wanted_values(corpus, shapes, head)) if short and () not in sets else corpus

    def key(shape: int, values: list[Column]) -> Column:
        texts = F.array(*[v.cast("string") for v in values]).cast("array<string>")
        return F.struct(F.lit(shape).alias("shape"), texts.alias("texts"))

    keys = F.array(*[key(i, [F.col(f) for f in fields]) for i, fields in enumerate(shapes)])
    asked = F.lit(None)
    for i, fields in enumerate(shapes):  # values as the columns print them, so that "07" finds the number 7
        values = [F.col("filters")[f].try_cast(corpus.schema[f].dataType) for f in fields]
        asked = F.when(names == F.array(*[F.lit(f) for f in fields]).cast("array<string>"), key(i, values)).otherwise(asked)
    part = specs.select("spec", *carry, asked.alias("__key")).where(~F.exists("__key.texts", lambda t: t.isNull()))
    keyed = docs.withColumn("__key", F.explode(keys))
    return keyed.join(broadcast_within(part, sum(sets.values())), "__key").drop("__key")


def _wanted_values(corpus: DataFrame, shapes: Sequence[tuple[str, ...]], rows) -> Column:
    """What any of the filter maps in ``rows`` can match, as IN lists of the columns' types."""
    parts = []
    for fields in shapes:
        mine = [r["filters"] for r in rows if tuple(sorted(r["filters"])) == fields]
        lists = [F.col(f).isin([F.lit(v).try_cast(corpus.schema[f].dataType) for v in sorted({m[f] for m in mine})]) for f in fields]
        parts.append(reduce(lambda a, b: a & b, lists))
    return reduce(lambda a, b: a | b, parts)
