"""Ranked hit lists: union, repeats, final order, citations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import first_present, folded
from lectern.plans.sizing import broadcast_within, staged, top_per_group
from lectern.settings import (
    CITATION_CHARS,
    CONTENT_KEY_CHARS,
    DESCRIPTION_FIELDS,
    MERGED_HITS,
    TITLE_FIELDS,
    TYPE_FIELDS,
)

FUSION_CONSTANT = 60  # ranks are added up as 1 / (constant + rank)

CITATION = (
    "struct<idx:int,score:double,id:string,title:string,description:string,"
    "activity:string,location:string,type:string>"
)


def merge_hits(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists, ``first`` ahead, each document once per question: adds ``branch`` and ``merge_rk``."""
    cols = ["qid", "doc_id", "score", "rk"]
    both = first.select(*cols, F.lit(1).alias("branch")).unionByName(second.select(*cols, F.lit(2).alias("branch")))
    order = [F.asc("branch"), F.asc("rk")]
    once = top_per_group(both, ["qid", "doc_id"], order, 1, rank="__n").drop("__n")
    return once.withColumn("merge_rk", F.row_number().over(W.partitionBy("qid").orderBy(*order)))


def fetch_docs(
    hits: DataFrame, corpus: DataFrame, rows: int | None = None, id_col: str = "doc_id", row_bytes: int = 96
) -> DataFrame:
    """Hits with their documents' columns.

    ``rows`` is a known bound on the hits; without one they are written first and counted. Few enough, they are
    broadcast, so that the corpus isn't shuffled for them.
    """
    if rows is None:
        hits = staged(hits, "hits")
        rows = hits.count()
    return corpus.join(broadcast_within(hits, rows, row_bytes), id_col)


def content_keys(df: DataFrame, chars: int | None = CONTENT_KEY_CHARS) -> list[Column]:
    """Title and the first ``chars`` of the description (None: all of it), in the form repeats are found by."""
    description = first_present(df, DESCRIPTION_FIELDS, "")
    start = description if chars is None else F.left(description, F.lit(chars))
    return [
        folded(first_present(df, TITLE_FIELDS, "")).alias("__title"),
        folded(start).alias("__description"),
    ]


def dedup_hits(
    hits: DataFrame,
    field: str | None = None,
    group: Sequence[str] = ("qid",),
    order: str = "merge_rk",
    content_chars: int | None = CONTENT_KEY_CHARS,
) -> DataFrame:
    """First hit of each content, or of each value of ``field``.

    ``content_chars``: how much of the description counts as content; None is all of it.

    Every partition keeps one row per key before the shuffle, so many copies cost no task.
    """
    if field is None:
        keys = content_keys(hits, content_chars)
    else:
        keys = [folded(F.coalesce(F.col(field).cast("string"), F.lit(""))).alias("__value")]
    names = [f"__key{i}" for i in range(len(keys))]
    keyed = hits.withColumns(dict(zip(names, keys)))
    return top_per_group(keyed, [*group, *names], [F.asc(order)], 1, rank="__n").drop("__n", *names)


def rank_hits(hits: DataFrame, n: int = MERGED_HITS) -> DataFrame:
    """Best ``n`` hits per question by score, earlier merged first among equals.

    The scores of both searches are compared as they are, as documented.
    """
    return top_per_group(hits.drop("rk"), ["qid"], [F.desc("score"), F.asc("merge_rk")], n)


def fuse_hits(lists: Sequence[DataFrame], n: int = MERGED_HITS, constant: int = FUSION_CONSTANT) -> DataFrame:
    """Best ``n`` documents per question by their ranks alone: ``qid, doc_id, score, rk, n_lists``.

    Each list (``qid, doc_id, rk``) adds ``1 / (constant + rk)``. The first n of any list have at least ``1 / (constant + n)``, and
    a document that stands below rank m in each of L lists at most ``L / (constant + m + 1)``. So only documents
    within the :func:`fusion_depth` of some list are looked at, and the rest of the lists only for these; the result is
    that of the whole lists. Equal scores go by the best rank, then by id.
    """
    depth = fusion_depth(n, len(lists), constant)
    parts = [df.select("qid", "doc_id", "rk", F.lit(i).alias("list")) for i, df in enumerate(lists)]
    whole = reduce(DataFrame.unionByName, parts)
    early = whole.where(F.col("rk") <= depth).select("qid", "doc_id").distinct()
    late = whole.where(F.col("rk") > depth).join(early, ["qid", "doc_id"], "left_semi")
    # a document counts once in each list, with its best rank there
    once = whole.where(F.col("rk") <= depth).unionByName(late).groupBy("qid", "doc_id", "list").agg(F.min("rk").alias("rk"))
    ranks = once.groupBy("qid", "doc_id").agg(F.sort_array(F.collect_list("rk")).alias("ranks"))
    total = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + 1 / (constant + r))
    fused = ranks.select(
        "qid", "doc_id", F.round(total, 12).alias("score"), F.col("ranks")[0].alias("first"), F.size("ranks").alias("n_lists"))
    top = top_per_group(fused, ["qid"], [F.desc("score"), F.asc("first"), F.asc("doc_id")], n, spread_on=["doc_id"])
    return top.select("qid", "doc_id", "score", "rk", "n_lists")


def fusion_depth(n: int, lists: int, constant: int = FUSION_CONSTANT) -> int:
    """The least rank m with ``lists / (constant + m + 1) < 1 / (constant + n)``."""
    return max(n, lists * (constant + n) - constant)


def uncovered_values(values: DataFrame, docs: DataFrame, field: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows of ``values`` whose ``value`` no document of ``docs`` holds in ``field``, ignoring case."""
    covered = docs.select(*group, folded(F.col(field)).alias("__covered")).where("__covered <> ''").distinct()
    keyed = values.withColumn("__covered", F.lower("value"))
    return keyed.join(covered, [*group, "__covered"], "left_anti").drop("__covered")


def citation(df: DataFrame, id_col: str = "doc_id", chars: int = CITATION_CHARS) -> Column:
    """One hit as a citation; ``df`` has the hit's ``rk`` and ``score`` and the document's columns."""
    return F.struct(
        F.col("rk").cast("int").alias("idx"),
        F.round("score", 4).alias("score"),
        F.col(id_col).cast("string").alias("id"),
        first_present(df, TITLE_FIELDS, "Untitled").alias("title"),
        F.left(first_present(df, DESCRIPTION_FIELDS, ""), F.lit(chars)).alias("description"),
        first_present(df, ("activity_name",), "").alias("activity"),
        first_present(df, ("location_name",), "").alias("location"),
        first_present(df, TYPE_FIELDS, "").alias("type"),
    )


def citations(hits: DataFrame, max_sources: int | None = None) -> DataFrame:
    """``qid, sources``: every hit's citation in rank order, or the first ``max_sources``."""
    kept = hits if max_sources is None else hits.where(F.col("rk") <= max_sources)
    listed = F.array_sort(F.collect_list(citation(kept)))  # idx leads the struct
    return kept.groupBy("qid").agg(listed.alias("sources"))
