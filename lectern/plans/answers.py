"""From a table of questions to a table of reports."""

from __future__ import annotations

import time
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators import aggregates as agg
from lectern.operators import synthesis
from lectern.operators.context import build_context, chunk_context
from lectern.operators.embedding import Embed, HashedWords, embed_table
from lectern.operators.filters import clean
from lectern.operators.hits import CITATION, citations, dedup_hits, fetch_docs, merge_hits, rank_hits
from lectern.operators.knn import knn_search
from lectern.functions.text import folded, strip
from lectern.operators.lexical import filtered_page, lexical_search, page_limit
from lectern.operators.reports import build_reports
from lectern.operators.vector_index import VectorIndex
from lectern.plans.route import route
from lectern.plans.sizing import broadcast_within, settled, staged
from lectern.rules import DEFAULT_MODE, FIELD_WORDS, INTENT_PATTERNS, MODES
from lectern.settings import (
    CHUNK_CHARS,
    CHUNKED_CONTEXT_CHARS,
    CONTENT_KEY_CHARS,
    CONTEXT_CHARS,
    CONTEXT_FIELDS,
    DESCRIPTION_FIELDS,
    FILTER_FIELDS,
    KNN_K,
    LEXICAL_DOCS,
    MAX_CHUNKS,
    MERGED_HITS,
    QUESTION_BUCKETS,
    TITLE_FIELDS,
    TYPE_FIELDS,
)

SHOWN = tuple(dict.fromkeys(
    [*CONTEXT_FIELDS, *TITLE_FIELDS, *DESCRIPTION_FIELDS, *TYPE_FIELDS, "embedded_text"]
))


def answer_questions(
    questions: DataFrame,
    vectors: DataFrame,
    embed: Embed | None = None,
    generate: synthesis.Generate | None = None,
    dim: int | None = None,
    cues=INTENT_PATTERNS,
    words=FIELD_WORDS,
    max_buckets: int = QUESTION_BUCKETS,
    max_sources: int | None = None,
    with_sources: bool = False,
    statistics: DataFrame | None = None,
    index_name: str = "documents",
    model: str = "extract",
    embed_model: str = "hashed-words",
    k: int = KNN_K,
    max_docs: int = LEXICAL_DOCS,
    max_hits: int = MERGED_HITS,
    context_chars: int = CONTEXT_CHARS,
    chunked_context_chars: int = CHUNKED_CONTEXT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
    max_chunks: int | None = MAX_CHUNKS,
    content_chars: int | None = CONTENT_KEY_CHARS,
    search: str = "exact",
    index: VectorIndex | None = None,
) -> DataFrame:
    """One report per question.

    ``questions`` has ``qid, query, mode, filters``; ``vectors`` is a vector table. All
    questions of a kind are answered together: one pass for the value lists, one for the
    vector search, two for the word search (one with saved ``statistics``) and one to fetch
    the documents found.
    Documents found and generated texts are written to the shared folder between steps, and so
    are questions and hits that are not few.
    ``max_sources`` cuts the citations of chunked answers (8 in the documented form);
    by default every source that was read is cited. ``with_sources`` adds
    sample documents to plain value lists.

    ``k`` hits of the vector search (``search``: exact or approx, with an ``index`` of ``vectors``) and ``max_docs`` of the word search are merged and
    the best ``max_hits`` fill ``chunked_context_chars`` of context, read in chunks of ``chunk_chars``. Of these ``max_chunks`` are
    read (None: all); a note tells how many were not. Vectors have ``dim`` numbers, by default as many as the
    table's; others are an error. A question that can't be answered (blank, unknown mode, a filter on a field
    that is unknown or not in the table) gets a report that says so; no questions, no reports.
    """
    started = time.time()
    given = F.coalesce("filters", F.create_map().cast("map<string,string>"))
    columns = ["qid", "query", "mode", "filters", "intent", "enum_field", "strategy"]
    mode = folded(F.coalesce("mode", F.lit("")))
    questions = questions.withColumns({
        "query": strip(F.coalesce("query", F.lit(""))), "mode": F.when(mode == "", F.lit(DEFAULT_MODE)).otherwise(mode),
        "filters": given})
    asked = route(questions, cues, words)
    asked = settled(asked.select(*columns, _problem(questions, vectors).alias("problem")), "questions")
    refused = asked.where("problem IS NOT NULL")
    asked = asked.where("problem IS NULL").select(*columns)
    kinds = asked.groupBy("strategy", "enum_field").count().collect()
    present = Counter()
    for row in kinds:
        present[row["strategy"]] += row["count"]
    n_questions = sum(present.values())
    if dim is None:
        first = vectors.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
        dim = first.n if first else 64

    def of(strategy: str) -> DataFrame:
        return asked.where(F.col("strategy") == strategy)

    listing = asked.where(F.col("strategy").isin("direct_aggregation", "aggregation_plus_llm"))
    searching = asked if with_sources else asked.where("strategy <> 'direct_aggregation'")

    total_docs = vectors.count()
    counting = present.keys() & {"direct_aggregation", "aggregation_plus_llm"}
    lists = summaries = hits = merged = None

    if counting:
        fields = sorted({row["enum_field"] for row in kinds if row["strategy"] in counting})
        lists, summaries = agg.terms_for_questions(vectors, listing, max_buckets, fields)
        lists = lists.withColumnRenamed("field", "enum_field")
        summaries = summaries.withColumnRenamed("field", "enum_field")

    if n_questions and (with_sources or present.keys() != {"direct_aggregation"}):
        vectored = embed_table(
            searching, embed or HashedWords(dim), dim, text_col="query", vector_col="vector", strict=True
        )
        vectored = settled(vectored, "vectors", n_questions)
        hits = settled(knn_search(vectors, vectored, k, mode=search, index=index), "knn", n_questions * k)
    near = n_questions * k
    wide = present["knn_chunked"] * (k + page_limit(max_docs))
    if "knn_chunked" in present:
        merged = settled(_wide_search(of("knn_chunked"), hits, vectors, statistics, max_docs), "merged", wide)
    found = None if hits is None else _found_docs(vectors, hits, merged, near + wide)

    parts: list[DataFrame] = []
    if counting:
        keyed = agg.with_spec(listing).join(broadcast_within(summaries, n_questions), ["spec", "enum_field"])
        sample = None
        if hits is not None:
            sample = citations(fetch_docs(hits.join(listing.select("qid"), "qid", "left_semi"), found, near))
        if "direct_aggregation" in present:
            parts.append(_listed(keyed, lists, sample if with_sources else None, total_docs, index_name))
        if "aggregation_plus_llm" in present:
            parts.append(_distributed(keyed, lists, sample, generate))
    if "knn_single" in present:
        parts.append(_single(of("knn_single"), hits, found, generate, near, context_chars))
    if "knn_chunked" in present:
        parts.append(_chunked(
            of("knn_chunked"), merged, found, generate, max_sources, wide, max_hits, chunked_context_chars, chunk_chars,
            max_chunks, content_chars))
    parts.append(_refused(refused))

    # written before the reports are: the generator is called once however often they are read, and its time is known
    answered = staged(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "answered")
    return build_reports(answered, index_name, total_docs, model, embed_model, started)


def _problem(questions: DataFrame, vectors: DataFrame):
    """Why a question (stripped, its mode folded) can't be answered, or null. Blank filters ask for nothing, whatever their field."""
    usable = [f for f in FILTER_FIELDS if f in vectors.columns]
    odd = F.array_sort(F.filter(F.map_keys(clean(F.col("filters"))), lambda f: ~f.isin(*usable)))
    return (
        F.when(F.col("query") == "", F.lit("Please enter a query"))
        .when(~F.col("mode").isin(*MODES), F.concat(F.lit("Invalid mode: "), F.col("mode")))
        .when(F.size(odd) > 0, F.concat(F.lit("Unknown filter: "), F.array_join(odd, ", ")))
    )


def _refused(refused: DataFrame) -> DataFrame:
    """Questions with a problem, told as their answer."""
    none = F.lit(0).cast("bigint")
    return refused.select(
        *_question_columns()[:-1], F.lit("refused").alias("strategy"), F.col("problem").alias("answer"),
        F.array("problem").alias("notes"), F.lit(None).cast(AGGREGATION).alias("aggregation"),
        _no_sources().alias("sources"), none.alias("total_hits"), none.alias("deduplicated_hits"), none.alias("context_chars"))


def _wide_search(
    asked: DataFrame, hits: DataFrame, vectors: DataFrame, statistics: DataFrame | None, max_docs: int
) -> DataFrame:
    """Vector hits, then word hits not among them."""
    near = hits.join(asked.select("qid"), "qid", "left_semi")
    by_words = lexical_search(vectors, asked.where(F.size("filters") == 0), max_docs=max_docs, statistics=statistics)
    # a question that carries filters, blank ones too, gets the filtered page instead of a word search
    pages = filtered_page(vectors, asked.where(F.size("filters") > 0), max_docs)
    columns = ["qid", "doc_id", "score", "rk"]
    return merge_hits(near, by_words.select(*columns).unionByName(pages.select(*columns)))


def _found_docs(vectors: DataFrame, hits: DataFrame, merged: DataFrame | None, bound: int) -> DataFrame:
    """The shown columns of every document any question found: the one scan that reads them."""
    columns = [c for c in dict.fromkeys(("doc_id", *SHOWN)) if c in vectors.columns]
    ids = hits.select("doc_id")
    if merged is not None:
        ids = ids.union(merged.select("doc_id"))
    return staged(fetch_docs(ids.distinct(), vectors.select(*columns), bound), "found")


AGGREGATION = "struct<field:string,total_unique:bigint,returned_values:bigint,is_complete:boolean>"


def _summary():
    return F.struct(
        F.col("enum_field").alias("field"), "total_unique",
        F.col("returned").alias("returned_values"), "is_complete",
    ).cast(AGGREGATION).alias("aggregation")


def _listed(keyed, lists, sample, total_docs, index_name) -> DataFrame:
    """Plain value lists: no text generation."""
    direct = keyed.where("strategy = 'direct_aggregation'")
    line = agg.report_line(F.col("rk"), F.col("value"), F.col("count"))
    texts = agg.value_text(lists, ["spec", "enum_field"], line)
    joined = direct.join(texts, ["spec", "enum_field"], "left")
    source_lines = source_count = None
    if sample is not None:
        joined = joined.join(sample, "qid", "left")
        shown = F.transform(
            F.slice(F.col("sources"), 1, 8),
            lambda s: F.concat(
                F.format_string("- [%d] %s", s["idx"], s["title"]),
                F.when(s["location"] != "", F.concat(F.lit(" | "), s["location"])).otherwise(F.lit("")),
            ),
        )
        source_lines = F.coalesce(F.array_join(shown, "\n"), F.lit(""))
        source_count = F.size("sources")
    answer = agg.enumeration_answer(
        F.col("enum_field"), F.coalesce("lines", F.lit("")), F.col("total_unique"), F.col("returned"),
        F.col("is_complete"), F.col("notes"), F.lit(total_docs), F.lit(index_name), source_lines, source_count,
    )
    columns = _question_columns() + [answer.alias("answer"), "notes", _summary()]
    if sample is not None:
        columns += ["sources", F.size("sources").cast("bigint").alias("total_hits"),
                    F.size("sources").cast("bigint").alias("deduplicated_hits")]
    else:
        columns += [_no_sources().alias("sources"), F.lit(0).cast("bigint").alias("total_hits"),
                    F.lit(0).cast("bigint").alias("deduplicated_hits")]
    return joined.select(*columns, F.lit(0).cast("bigint").alias("context_chars"))


def _no_sources():
    return F.array().cast(f"array<{CITATION}>")


def _question_columns() -> list:
    return ["qid", "query", "mode", "filters", "intent", "enum_field", "strategy"]


def _distributed(keyed, lists, sample, generate) -> DataFrame:
    """Value lists with shares, put in words by the generator."""
    spread = keyed.where("strategy = 'aggregation_plus_llm'")
    with_total = lists.join(
        spread.select("spec", "enum_field", "total").dropDuplicates(["spec", "enum_field"]), ["spec", "enum_field"]
    )
    line = agg.share_line(F.col("rk"), F.col("value"), F.col("count"), F.col("total"))
    texts = agg.value_text(with_total, ["spec", "enum_field"], line)
    joined = spread.join(texts, ["spec", "enum_field"], "left")
    values = agg.agg_context(
        F.col("enum_field"), F.coalesce("lines", F.lit("")), F.col("total_unique"), F.col("returned"),
        F.col("is_complete"),
    )
    prompts = joined.withColumn("prompt", synthesis.distribution_prompt(F.col("mode"), values, F.col("query")))
    answers = synthesis.generate_text(prompts, generate).join(sample, "qid", "left")
    return answers.select(
        *_question_columns(), "answer", F.array().cast("array<string>").alias("notes"), _summary(), "sources",
        F.size(F.coalesce("sources", _no_sources())).cast("bigint").alias("total_hits"),
        F.size(F.coalesce("sources", _no_sources())).cast("bigint").alias("deduplicated_hits"),
        F.lit(0).cast("bigint").alias("context_chars"),
    )


def _searched(asked, answers, counts, cited) -> DataFrame:
    """Answers of a search strategy; questions without hits keep a null answer."""
    joined = asked.join(answers, "qid", "left").join(counts, "qid", "left").join(cited, "qid", "left")
    notes = F.col("notes") if "notes" in answers.columns else F.lit(None)
    return joined.select(
        *_question_columns(), "answer",
        F.coalesce(notes, F.array().cast("array<string>")).cast("array<string>").alias("notes"),
        F.lit(None).cast(AGGREGATION).alias("aggregation"), "sources",
        "total_hits", "deduplicated_hits", F.col("context_chars").cast("bigint").alias("context_chars"),
    )


def _single(asked, hits, docs, generate, rows, context_chars) -> DataFrame:
    """The nearest documents in one prompt."""
    mine = staged(fetch_docs(hits.join(asked.select("qid"), "qid", "left_semi"), docs, rows), "single")
    prompts = asked.join(build_context(mine, context_chars), "qid").withColumn(
        "prompt", synthesis.single_prompt(F.col("mode"), F.col("context"), F.col("query"))
    )
    answers = synthesis.generate_text(prompts, generate).select(
        "qid", "answer", F.length("context").alias("context_chars")
    )
    counts = mine.groupBy("qid").agg(F.count(F.lit(1)).alias("total_hits"))
    return _searched(asked, answers, counts.withColumn("deduplicated_hits", F.col("total_hits")), citations(mine))


def _chunked(
    asked, merged, docs, generate, max_sources, rows, max_hits, context_chars, chunk_chars, max_chunks, content_chars
) -> DataFrame:
    """Many documents, merged and ranked, read by the generator chunk by chunk."""
    # a question has a few hundred hits at most, so they can be counted where they are ranked
    per_question = W.partitionBy("qid")
    counted = merged.withColumn("total_hits", F.count(F.lit(1)).over(per_question))
    # only the keys of the documents take part until the best are known
    unique = dedup_hits(fetch_docs(counted, docs, rows), content_chars=content_chars).select("qid", "doc_id", "score", "rk", "merge_rk", "total_hits")
    unique = unique.withColumn("deduplicated_hits", F.count(F.lit(1)).over(per_question))
    ranked = staged(fetch_docs(rank_hits(unique, max_hits), docs, rows), "ranked")
    counts = ranked.where("rk = 1").select("qid", "total_hits", "deduplicated_hits")
    context = build_context(ranked, context_chars)
    cut = staged(chunk_context(context, chunk_chars, max_chunks), "chunks")
    notes = F.when(F.col("n_dropped") > 0, F.array(F.format_string(
        "%d of %d parts of the documents found were not read", F.col("n_dropped"), F.col("n_chunks") + F.col("n_dropped")
    ))).otherwise(F.array().cast("array<string>"))
    noted = cut.withColumn("notes", notes)
    answers = synthesis.synthesize(asked.select("qid", "query", "mode").join(noted, "qid"), generate, notes=True)
    # what no prompt has shown is neither counted nor cited
    marks = F.regexp_extract_all("chunk", F.lit(r"\[Source (\d+)\]"), F.lit(1))
    read = cut.groupBy("qid").agg(
        F.sum(F.length("chunk")).alias("context_chars"), F.flatten(F.collect_list(marks)).alias("marks"))
    shown = _read_hits(ranked, read)
    answers = answers.join(read.select("qid", "context_chars"), "qid").join(
        noted.where("chunk_no = 1").select("qid", "notes"), "qid")
    return _searched(asked, answers, counts, citations(shown, max_sources))


def _read_hits(ranked: DataFrame, read: DataFrame) -> DataFrame:
    """The hits whose number stands in a chunk that was read."""
    side = read.select("qid", F.transform("marks", lambda m: m.cast("int")).alias("marks"))
    return ranked.join(side, "qid").where(F.array_contains("marks", F.col("rk").cast("int"))).drop("marks")
