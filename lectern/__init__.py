"""Question-driven analytics over document tables, on Spark."""

from lectern.operators.aggregates import (
    coverage_percent,
    distinct_count,
    distribution,
    facets,
    multi_terms_agg,
    terms_agg,
)
from lectern.operators.bitmaps import ValueIndex, build_value_index, load_value_index, value_counts
from lectern.operators.context import build_context, chunk_context, fixed_chunks, passages
from lectern.operators.embedding import HashedWords, embed_table
from lectern.operators.filters import accepted, apply_filters, parse_filters
from lectern.operators.heavy import top_values
from lectern.operators.hits import (
    citations,
    dedup_hits,
    fetch_docs,
    fuse_hits,
    merge_hits,
    rank_hits,
    uncovered_values,
)
from lectern.operators.knn import knn_search
from lectern.operators.lexical import filtered_page, lexical_search, term_statistics
from lectern.operators.questions import check_questions
from lectern.operators.reports import build_reports
from lectern.operators.sketches import field_sketches, merged_sketches, read_sketches, save_sketches, sketch_counts
from lectern.operators.synthesis import build_prompts, synthesize
from lectern.operators.vector_index import VectorIndex, build_vector_index, load_vector_index
from lectern.operators.word_index import WordIndex, build_word_index, indexed_search
from lectern.plans.answers import answer_questions
from lectern.plans.route import classify_intent, resolve_field, route
from lectern.plans.word_rules import resolve_by_rules
from lectern.sources.corpus import corpus_count, load_corpus, preview_text
from lectern.sources.reports import (
    find_report,
    list_reports,
    load_report,
    newest_reports,
    read_manifest,
    read_reports,
    save_reports,
)
from lectern.sources.vectors import (
    build_vector_table,
    compact_vectors,
    ingest_report,
    publish,
    quarantine,
    read_vectors,
    try_search,
    unused_folders,
    upsert_vectors,
    verify_vectors,
    with_vectors,
)

__all__ = [n for n in dir() if not n.startswith("_")]
