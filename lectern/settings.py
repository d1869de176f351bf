"""Field lists and limits.

The names and numbers below are fixed values: results only agree with the
Every function takes them as arguments, so other corpora can pass their own.
"""

from __future__ import annotations

# Fields joined into the text that is embedded, in order.
EMBED_FIELDS = (
    "description", "title", "orignal_description", "paragraph", "form_data_search",
    "source_data", "activity_name", "location_name", "form_title", "form_type",
    "activity_type", "source_type", "relevance", "sentiment_label", "doc_data_type",
    "keywords", "equipment_name", "equipment_type", "name", "type",
    "sub_activity_type", "remark", "remarks", "comment", "comments",
)

# Fields shown in a context passage, in order.
CONTEXT_FIELDS = (
    "description", "title", "orignal_description", "paragraph", "form_data_search",
    "source_data", "activity_name", "location_name", "form_title", "form_type",
    "activity_type", "equipment_name", "equipment_type", "name", "remark", "remarks",
)

# Fields the lexical search looks at.
LEXICAL_FIELDS = (
    "description", "title", "location_name", "activity_name",
    "form_title", "form_data_search", "source_data", "paragraph",
)

# Facet fields and how many values each one lists.
FACET_LIMITS = {
    "activity_type": 50,
    "form_type": 50,
    "source_type": 50,
    "location_name": 100,
    "activity_name": 100,
}

# Filter fields a question may carry.
FILTER_FIELDS = ("activity_type", "form_type", "source_type", "location_name", "activity_name")

TITLE_FIELDS = ("title", "form_title", "name")
DESCRIPTION_FIELDS = ("description", "orignal_description")
TYPE_FIELDS = ("form_type", "source_type")

KNOWN_FIELDS = EMBED_FIELDS + ("status",)

# Limits that are part of the results.
KNN_K = 10
CONTEXT_CHARS = 8000
CHUNKED_CONTEXT_CHARS = 32000
DEFAULT_BUCKETS = 200
QUESTION_BUCKETS = 2000
LEXICAL_PAGE = 50
LEXICAL_DOCS = 200
MERGED_HITS = 30
CHUNKED_CITATIONS = 8
CHUNK_CHARS = 3000
MAX_CHUNKS = 8
CONTENT_KEY_CHARS = 100
CITATION_CHARS = 200
FALLBACK_CHARS = 500
STORED_TEXT_CHARS = 10000
TITLE_QUERY_CHARS = 60
LISTED_QUERY_CHARS = 80
PREVIEW_CHARS = 200

BM25_K1 = 1.2
BM25_B = 0.75

# Bounds on what is shipped to every executor. They are checked at run time;
# larger inputs take another path (several passes, or a shuffle join).
QUESTIONS_PER_PASS = 4096
QUESTION_BYTES_PER_PASS = 32 * 1024 * 1024
BROADCAST_BYTES = 64 * 1024 * 1024
IN_LIST_VALUES = 200
