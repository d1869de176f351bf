"""One query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import lectern as L
from lectern.operators import aggregates as agg
from lectern.operators import synthesis
from lectern.functions.text import embedding_text as text_to_embed
from lectern.operators.filters import clean, match_filters
from lectern.operators.hits import CITATION
from lectern.plans.sizing import staged, staging_dir
from workload.tables import (
    corpus,
    listing_questions,
    opened_questions,
    table,
    talk_questions,
    text_questions,
    vector_questions,
    vector_table,
)


def r4(name):
    return F.round(name, 4).alias(name)


# --- value lists -----------------------------------------------------------

def terms_agg(spark, sf):
    return L.terms_agg(table(spark, sf, "part"), "p_brand")


def terms_agg_filtered(spark, sf):
    return L.terms_agg(table(spark, sf, "part"), "p_brand", filters={"p_type": " ECONOMY ", "p_name": " "})


def terms_agg_capped(spark, sf):
    return L.multi_terms_agg(table(spark, sf, "orders"), {"o_custkey": 10})


def top_values(spark, sf):
    """The most frequent of all words, of which there are very many."""
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return L.top_values(words, "word", 100, keep=2000)


def terms_agg_least(spark, sf):
    return L.terms_agg(table(spark, sf, "lineitem"), "l_suppkey", max_buckets=5, ascending=True)


def distinct_count(spark, sf):
    return L.distinct_count(table(spark, sf, "part"), ["p_brand", "p_type", "p_name", "p_size"])


def distinct_count_approx(spark, sf):
    return L.distinct_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], approximate=True)


def distinct_sketches(spark, sf):
    """Sketches of two halves of a table, stored, merged and held against the exact counts."""
    fields, lines, root = ["l_orderkey", "l_partkey", "l_suppkey"], table(spark, sf, "lineitem"), _new_folder(spark, "sketches")
    for version in (1, 2):
        half = lines.where(F.col("l_linenumber") % 2 == version - 1)
        L.save_sketches(L.field_sketches(half, fields, version), root)
    near = L.sketch_counts(L.read_sketches(spark, root))
    exact = L.distinct_count(lines, fields).withColumnRenamed("total_unique", "exact")
    off = F.abs(F.col("total_unique") - F.col("exact"))
    return near.join(exact, "field").select("field", "exact", (off <= 4 * F.col("error") * F.col("exact")).alias("within_error"))


def multi_terms_agg(spark, sf):
    return L.multi_terms_agg(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


def facets(spark, sf):
    found = L.facets(corpus(spark, sf), {"source_type": 50, "form_type": 50, "title": 100})
    return found.select("field", F.array_join("options", "|").alias("options"))


def _value_index(spark, sf, docs):
    return L.build_value_index(docs, _new_folder(spark, "values"), ["source_type", "form_type", "title"])


def facets_indexed(spark, sf):
    """From bitmaps, without the documents."""
    docs = corpus(spark, sf)
    found = L.facets(docs, {"source_type": 50, "form_type": 50, "title": 100}, index=_value_index(spark, sf, docs))
    return found.select("field", F.array_join("options", "|").alias("options"))


def distribution(spark, sf):
    return L.distribution(table(spark, sf, "events"), "event_type")


def coverage(spark, sf):
    listed = L.multi_terms_agg(table(spark, sf, "part"), {"p_brand": 10, "p_type": 50, "p_name": 20})
    one = listed.groupBy("field").agg(
        F.first("total_unique").alias("total_unique"), F.first("returned").alias("returned"),
        F.first("is_complete").alias("is_complete"),
    )
    return one.select(
        "*", L.coverage_percent(F.col("is_complete"), F.col("returned"), F.col("total_unique")).alias("percent")
    )


def _lists(spark, sf):
    asks = listing_questions(spark, sf).withColumn("enum_field", F.lit("source_type"))
    lists, summaries = agg.terms_for_questions(corpus(spark, sf), asks)
    return agg.with_spec(asks), lists, summaries


def terms_for_questions(spark, sf):
    asks, lists, _ = _lists(spark, sf)
    return asks.join(lists, "spec").select("qid", "field", "value", "count", "rk")


def terms_indexed(spark, sf):
    """The lists of all questions from bitmaps, without the documents."""
    docs = corpus(spark, sf)
    asks = listing_questions(spark, sf).withColumn("enum_field", F.lit("source_type"))
    lists, _ = agg.terms_for_questions(docs, asks, index=_value_index(spark, sf, docs))
    return agg.with_spec(asks).join(lists, "spec").select("qid", "field", "value", "count", "rk")


def agg_context(spark, sf):
    asks, lists, summaries = _lists(spark, sf)
    lines = agg.value_text(lists, ["spec"], agg.context_line(F.col("rk"), F.col("value"), F.col("count")))
    text = agg.agg_context(
        F.col("field"), F.col("lines"), F.col("total_unique"), F.col("returned"), F.col("is_complete")
    )
    return asks.join(summaries, "spec").join(lines, "spec").select("qid", text.alias("context"))


def _enumeration(spark, sf):
    asks, lists, summaries = _lists(spark, sf)
    lines = agg.value_text(lists, ["spec"], agg.report_line(F.col("rk"), F.col("value"), F.col("count")))
    answer = agg.enumeration_answer(
        F.col("field"), F.col("lines"), F.col("total_unique"), F.col("returned"), F.col("is_complete"),
        F.col("notes"), F.lit(table(spark, sf, "documents").count()), F.lit("documents"),
    )
    return asks.join(summaries, "spec").join(lines, "spec").select("*", answer.alias("answer"))


def enumeration_report(spark, sf):
    return _enumeration(spark, sf).select("qid", "answer", "total_unique", "returned", "is_complete")


def _enumeration_reports(spark, sf):
    answered = _enumeration(spark, sf).withColumns({
        "strategy": F.lit("direct_aggregation"),
        "intent": F.lit("enumeration"),
        "sources": F.array().cast(f"array<{CITATION}>"),
        "total_hits": F.lit(0), "deduplicated_hits": F.lit(0), "context_chars": F.lit(0),
        "aggregation": F.struct(
            F.col("field"), "total_unique", F.col("returned").alias("returned_values"), "is_complete"
        ),
    })
    return L.build_reports(answered, "documents", table(spark, sf, "documents").count(), "extract", "hashed-words")


def build_reports(spark, sf):
    return _enumeration_reports(spark, sf).select(
        "qid", "title", "mode", "mode_label", "query", "answer",
        F.col("metadata.strategy").alias("strategy"), F.col("metadata.intent").alias("intent"),
        F.col("metadata.is_enumeration").alias("is_enumeration"),
        F.col("metadata.index_total_docs").alias("index_total_docs"),
        F.col("metadata.aggregation.total_unique").alias("total_unique"),
        F.trim(F.col("metadata.filters")["form_type"]).alias("form_type"),
    )


def corpus_count(spark, sf):
    return spark.range(1).select(F.lit(L.corpus_count(corpus(spark, sf))).cast("bigint").alias("docs"))


def _new_folder(spark, name):
    return f"{staging_dir(spark)}/lectern/{name}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"


def _saved(spark, sf):
    path = _new_folder(spark, "reports")
    L.save_reports(_enumeration_reports(spark, sf), path)
    return L.read_reports(spark, path, qid="string")


def list_reports(spark, sf):
    return L.list_reports(_saved(spark, sf)).select("title", "mode", "query", "total_hits")


def load_report(spark, sf):
    saved = _saved(spark, sf)
    wanted = saved.orderBy("qid").first()["report_id"]
    return L.load_report(saved, wanted).select("qid", "title", "answer")


def saved_reports(spark, sf):
    """Two runs saved, one of them twice; the newest reports and one by its id, each from the runs that can hold it."""
    path, made = _new_folder(spark, "reports"), _enumeration_reports(spark, sf)
    for run in ("first", "second", "first"):
        L.save_reports(made, path, run=run)
    newest = L.newest_reports(spark, path, 1000, qid="string").select(F.lit("listed").alias("way"), "title", "query")
    wanted = L.read_reports(spark, f"{path}/run=second", qid="string").orderBy("qid").first()["report_id"]
    one = L.find_report(spark, path, wanted, qid="string").select(F.lit("found").alias("way"), "title", "query")
    return newest.unionByName(one)


# --- routing ---------------------------------------------------------------

def classify(spark, sf):
    return L.classify_intent(talk_questions(spark, sf)).select("conv_id", "turn", "intent")


def resolve_field(spark, sf):
    return L.resolve_field(talk_questions(spark, sf)).select("conv_id", "turn", "enum_field")


def resolve_by_rules(spark, sf):
    """Every word of a benchmark text is a rule that names the first item that has it; a line of talk gets the rarest item's."""
    words = table(spark, sf, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("word"))
    rules = words.where("word <> ''").groupBy("word").agg(F.min("item_id").alias("item"), F.count("*").alias("n")).select(
        "word", F.concat(F.lit("item "), F.col("item").cast("string")).alias("column"), (F.col("n") * 1000000 + F.col("item")).alias("place"))
    return L.resolve_by_rules(talk_questions(spark, sf), rules).select("conv_id", "turn", "enum_field")


def route(spark, sf):
    return L.route(talk_questions(spark, sf)).select(
        "conv_id", "turn", "intent", "enum_field", "strategy", "confidence"
    )


def check_questions(spark, sf):
    asked = talk_questions(spark, sf).withColumn(
        "filters",
        F.create_map(F.lit("form_type"), F.concat(F.lit(" "), "mode"), F.lit("source_type"), F.lit(" "),
                     F.lit("other"), F.lit("x")),
    ).withColumn("mode", F.when(F.col("turn") == 0, F.lit(" Answer ")).otherwise(F.col("mode")))
    return L.check_questions(asked).select(
        "conv_id", "turn", "query", "mode", F.to_json("filters").alias("filters"), "problem"
    )


def parse_filters(spark, sf):
    items = F.array(
        F.concat(F.lit("brand="), "p_brand"), "p_name", F.concat(F.lit("expr=a="), "p_type"),
        F.concat(F.lit("size="), F.col("p_size").cast("string")), F.lit("brand2="),
    )
    parsed = table(spark, sf, "part").select("p_partkey", L.parse_filters(items).alias("f"))
    return parsed.select(
        "p_partkey", F.col("f")["brand"].alias("brand"), F.col("f")["expr"].alias("expr"),
        F.col("f")["size"].alias("size"), F.col("f")["brand2"].alias("brand2"), F.size("f").alias("entries"),
    )


def apply_filters(spark, sf):
    asks = agg.with_spec(listing_questions(spark, sf)).select("spec", clean(F.col("filters")).alias("filters"))
    return match_filters(corpus(spark, sf), asks).select("spec", "doc_id")


# --- search ----------------------------------------------------------------

def _centroid_hits(spark, sf, filtered=False, **options):
    asked = vector_questions(spark, sf)
    if filtered:
        asked = asked.withColumn("filters", F.create_map(F.lit("label"), F.col("qid").cast("string")))
    found = L.knn_search(table(spark, sf, "embeddings"), asked, id_col="vec_id", **options)
    return found.select("qid", "doc_id", r4("score"), "rk")


def knn_topk(spark, sf):
    return _centroid_hits(spark, sf)


def knn_filtered(spark, sf):
    return _centroid_hits(spark, sf, filtered=True)


def knn_min_score(spark, sf):
    return _centroid_hits(spark, sf, k=50, min_score=0.7)


def knn_approx(spark, sf):
    """From an index. The given vectors have no neighbourhoods: it measures that and searches exactly."""
    index = L.build_vector_index(table(spark, sf, "embeddings"), _new_folder(spark, "index"), id_col="vec_id")
    return _centroid_hits(spark, sf, mode="approx", index=index)


def knn_one_scan(spark, sf):
    """Exact, from an index: one scan for any number of questions."""
    index = L.build_vector_index(table(spark, sf, "embeddings"), _new_folder(spark, "index"), id_col="vec_id")
    return _centroid_hits(spark, sf, index=index)


def knn_index(spark, sf):
    """From an index of vectors with neighbourhoods: the given ones, drawn to one of the first 25. Every 20th is asked."""
    given = table(spark, sf, "embeddings")
    middles = given.where("vec_id < 25").select(F.col("vec_id").alias("at"), F.col("embedding").alias("middle"))
    drawn = given.join(F.broadcast(middles), F.col("vec_id") % 25 == F.col("at")).select(
        "vec_id", F.zip_with("embedding", "middle", lambda x, m: (m + 0.35 * x).cast("float")).alias("embedding"))
    drawn = staged(drawn, "drawn")
    index = L.build_vector_index(drawn, _new_folder(spark, "index"), id_col="vec_id", k=5)
    asked = drawn.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = L.knn_search(drawn, asked, k=5, id_col="vec_id").select("qid", "doc_id", F.lit(1).alias("in_exact"))
    near = L.knn_search(drawn, asked, k=5, id_col="vec_id", mode="approx", index=index)
    both = near.select("qid", "doc_id", F.lit(1).alias("in_near")).join(exact, ["qid", "doc_id"], "full")
    return both.agg(
        F.count("in_exact").alias("wanted"), F.count("in_near").alias("found"),
        (F.count_if((F.col("in_exact") == 1) & (F.col("in_near") == 1)) >= 0.9 * F.count("in_exact")).alias("recall_ok"),
    ).select("*", F.lit(index.rows).cast("bigint").alias("indexed"), F.lit(not index.exact and index.share < 0.25).alias("share_ok"))


def knn_recent(spark, sf):
    return _centroid_hits(spark, sf, order_by=F.col("vec_id"))


def term_statistics(spark, sf):
    return L.term_statistics(corpus(spark, sf))


def lexical_bm25(spark, sf):
    found = L.lexical_search(corpus(spark, sf), text_questions(spark, sf))
    return found.select("qid", "doc_id", r4("score"), "rk")


def lexical_index(spark, sf):
    """The same search from a stored index of posting blocks."""
    index = L.build_word_index(corpus(spark, sf), _new_folder(spark, "words"))
    return L.indexed_search(index, text_questions(spark, sf)).select("qid", "doc_id", r4("score"), "rk")


def filtered_page(spark, sf):
    return L.filtered_page(corpus(spark, sf), listing_questions(spark, sf))


def embed_documents(spark, sf):
    return vector_table(spark, sf).select(
        "doc_id", "embed_ok", F.posexplode("embedding").alias("at", "x")
    ).where("x <> 0").select("doc_id", "embed_ok", "at", F.round(F.col("x").cast("double"), 5).alias("x"))


def _text_hits(spark, sf):
    """Vector hits of the text questions; the vector table is built once."""
    docs = staged(vector_table(spark, sf), "vectors")
    asked = L.embed_table(text_questions(spark, sf), text_col="query", vector_col="vector")
    return docs, L.knn_search(docs, asked)


def _merged(spark, sf):
    docs, near = _text_hits(spark, sf)
    return docs, L.merge_hits(near, L.lexical_search(docs, text_questions(spark, sf)))


def hybrid_merge(spark, sf):
    return _merged(spark, sf)[1].select("qid", "doc_id", r4("score"), "branch", "merge_rk")


def _ranked(spark, sf):
    docs, merged = _merged(spark, sf)
    unique = L.dedup_hits(L.fetch_docs(staged(merged, "merged"), docs))
    # texts stay behind until the best hits are known
    return L.fetch_docs(L.rank_hits(unique.select("qid", "doc_id", "score", "rk", "merge_rk")), docs)


def rank_hits(spark, sf):
    return _ranked(spark, sf).select("qid", "doc_id", r4("score"), "rk")


def fuse_hits(spark, sf):
    """Vector and word hits by their ranks alone."""
    docs, near = _text_hits(spark, sf)
    return L.fuse_hits([near, L.lexical_search(docs, text_questions(spark, sf))]).select(
        "qid", "doc_id", F.round("score", 9).alias("score"), "rk", "n_lists")


def dedup_content(spark, sf):
    return L.dedup_hits(corpus(spark, sf), group=(), order="doc_id").select("doc_id")


def dedup_field(spark, sf):
    return L.dedup_hits(corpus(spark, sf), field="title", group=("form_type",), order="doc_id").select(
        "form_type", "doc_id"
    )


def uncovered_values(spark, sf):
    docs = corpus(spark, sf)
    values = docs.where("title is not null").groupBy(F.col("title").alias("value")).count()
    seen = docs.join(table(spark, sf, "labels").where("toxic = 0").select("doc_id"), "doc_id")
    return L.uncovered_values(values, seen, "title")


def citations(spark, sf):
    docs, near = _text_hits(spark, sf)
    cited = L.citations(L.fetch_docs(near, docs))
    return cited.select("qid", F.explode("sources").alias("s")).select("qid", "s.*")


# --- text ------------------------------------------------------------------

def embedding_text(spark, sf):
    docs = corpus(spark, sf)
    return docs.select("doc_id", text_to_embed(docs).alias("t")).where("t <> ''").select(
        "doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest")
    )


def passages(spark, sf):
    return L.passages(corpus(spark, sf)).select(
        "doc_id", F.length("passage").alias("chars"), F.md5("passage").alias("digest")
    )


def preview_text(spark, sf):
    return L.preview_text(corpus(spark, sf))


def _contexts(spark, sf):
    docs, near = _text_hits(spark, sf)
    return L.build_context(L.fetch_docs(near, docs))


def build_context(spark, sf):
    return _contexts(spark, sf)


def chunk_context(spark, sf):
    return L.chunk_context(L.build_context(_ranked(spark, sf), 32000))


def fixed_chunks(spark, sf):
    words = F.split("p_name", " ")
    cut = L.fixed_chunks(F.concat(words, F.array("p_brand", "p_type")), 3)
    return table(spark, sf, "part").select("p_partkey", F.posexplode(cut).alias("no", "c")).select(
        "p_partkey", "no", F.array_join("c", ",").alias("items")
    )


def build_prompts(spark, sf):
    asked = text_questions(spark, sf).join(_contexts(spark, sf), "qid")
    prompt = synthesis.single_prompt(F.col("mode"), F.col("context"), F.col("query"))
    return asked.select("qid", prompt.alias("prompt"))


def prompt_kinds(spark, sf):
    """Every kind of prompt for every line of talk, the lines in turn in each mode and in one that isn't known."""
    modes = F.array(*[F.lit(m) for m in ("answer", "analyze", "predict", "summarize", "other")])
    body, query = F.col("text"), F.concat(F.lit("About line "), F.col("turn").cast("string"))
    notes = F.array(F.lit("a list was cut"), F.concat(F.lit("mode "), "mode"))
    kinds = {
        "lists": synthesis.distribution_prompt(F.col("mode"), body, query),
        "short": synthesis.single_prompt(F.col("mode"), body, query),
        "whole": synthesis.chunk_prompt(F.col("mode"), body, query, F.lit(1), F.lit(1), F.lit(""), notes),
        "bare": synthesis.chunk_prompt(F.col("mode"), body, query, F.lit(1), F.lit(1), F.lit("")),
        "share": synthesis.chunk_prompt(F.col("mode"), body, query, F.lit(2), F.lit(4), F.lit(""), notes),
        "last": synthesis.chunk_prompt(F.col("mode"), body, query, F.lit(4), F.lit(4), F.concat(F.lit("noted "), body), notes),
    }
    asked = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"),
        F.element_at(modes, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int")).alias("mode"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("prompt")) for k, p in kinds.items()]))
    return asked.select("conv_id", "turn", "mode", each.alias("p")).select("conv_id", "turn", "mode", "p.kind", "p.prompt")


def synthesize(spark, sf):
    contexts = staged(L.build_context(_ranked(spark, sf), 32000), "context")
    chunks = text_questions(spark, sf).select("qid", "query", "mode").join(L.chunk_context(contexts), "qid")
    return L.synthesize(chunks)


# --- vector table ----------------------------------------------------------

def build_vector_table(spark, sf):
    """Build a table, then build it again over itself with the languages of the labelled documents marked."""
    docs, root = corpus(spark, sf), _new_folder(spark, "table")
    L.build_vector_table(docs, root)
    marked = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").withColumn(
        "form_type", F.concat(F.lit("labelled "), "form_type")
    )
    return L.build_vector_table(marked, root, mode="upsert").select(
        "doc_id", "form_type", "embed_ok", F.length("embedded_text").alias("stored_chars")
    )


def bucketed_vector_table(spark, sf):
    """The same in folders by id, the marked rows put in place in theirs alone, then compacted."""
    docs, root = corpus(spark, sf), _new_folder(spark, "table")
    L.build_vector_table(docs, root, buckets=16)
    marked = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").withColumn(
        "form_type", F.concat(F.lit("labelled "), "form_type")
    )
    L.build_vector_table(marked, root, mode="upsert")
    return L.compact_vectors(spark, root).select(
        "doc_id", "form_type", "embed_ok", F.length("embedded_text").alias("stored_chars")
    )


def try_search(spark, sf):
    return L.try_search(vector_table(spark, sf), "the tion of here", k=3).select("doc_id", r4("score"), "rk")


def upsert_vectors(spark, sf):
    old = table(spark, sf, "embeddings")
    new = old.select(
        (F.col("vec_id") * 2).alias("vec_id"), F.reverse("embedding").alias("embedding"),
        (F.col("label") + 100).alias("label"),
    )
    new = new.unionByName(new.withColumn("label", F.col("label") + 100))
    return L.upsert_vectors(old, new, "vec_id", F.asc("label")).select(
        "vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 5).alias("first")
    )


def verify_vectors(spark, sf):
    return L.verify_vectors(table(spark, sf, "embeddings"), 64)


class _NoBars(L.HashedWords):
    """Refuses texts with a bar in them."""

    def __call__(self, texts):
        if any("|" in t for t in texts):
            raise ValueError("bar")
        return super().__call__(texts)


def ingest_report(spark, sf):
    return L.ingest_report(L.with_vectors(corpus(spark, sf), _NoBars()))


# --- questions to reports --------------------------------------------------

def answer_questions(spark, sf) -> DataFrame:
    """Reports for every benchmark text, asked in one of several ways, and every language listing."""
    asked = opened_questions(spark, sf).withColumn("qid", F.col("qid").cast("string"))
    asked = asked.unionByName(listing_questions(spark, sf))
    docs = staged(vector_table(spark, sf), "vectors")
    reports = L.answer_questions(asked, docs, words=DOCUMENT_WORDS)
    return reports.select(
        "qid", "title", "mode_label", "answer", F.size("sources").alias("n_sources"),
        F.col("metadata.strategy").alias("strategy"), F.col("metadata.total_hits").alias("total_hits"),
        F.col("metadata.deduplicated_hits").alias("deduplicated_hits"),
        F.col("metadata.context_chars").alias("context_chars"),
    )


# Field words for the documents table.
DOCUMENT_WORDS = {
    "source": "source_type", "sources": "source_type", "site": "source_type", "sites": "source_type",
    "location": "source_type", "locations": "source_type", "task": "source_type", "tasks": "source_type",
    "type": "form_type", "types": "form_type", "language": "form_type", "languages": "form_type",
    "category": "form_type", "categories": "form_type",
}


QUERIES = {
    f.__name__: f
    for f in (
        terms_agg, terms_agg_filtered, terms_agg_capped, top_values, terms_agg_least, distinct_count, distinct_count_approx,
        distinct_sketches, facets_indexed, terms_indexed, fuse_hits,
        multi_terms_agg, facets, distribution, coverage, terms_for_questions, agg_context, enumeration_report,
        build_reports, list_reports, load_report, saved_reports, classify, resolve_field, resolve_by_rules, route, check_questions, parse_filters,
        apply_filters, knn_topk, knn_filtered, knn_min_score, knn_approx, knn_one_scan, knn_index, knn_recent, term_statistics, lexical_bm25,
        lexical_index, filtered_page, embed_documents, hybrid_merge, rank_hits, dedup_content, dedup_field, uncovered_values,
        citations, embedding_text, passages, preview_text, corpus_count, build_context, chunk_context, fixed_chunks,
        build_prompts, prompt_kinds, synthesize, build_vector_table, bucketed_vector_table, try_search, upsert_vectors, verify_vectors, ingest_report,
        answer_questions,
    )
}
