"""The same results in SQL, for the check against DuckDB."""

from __future__ import annotations

from lectern.functions.text import WHITE_SPACE
from lectern.rules import FIELD_WORDS, STRATEGIES, field_patterns, intent_patterns
from lectern.operators import synthesis
from lectern.rules import ALWAYS, MODE_INSTRUCTIONS
from workload.tables import OPENINGS

SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"
WORD_BREAK = r"[^\p{L}\p{M}\p{N}_]+"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


# RE2 reads \w, \s, \d and \b as ASCII: spell the Unicode classes out
LETTER = r"\p{L}\p{M}\p{N}_"


def wide(pattern: str) -> str:
    for short, inner in ((r"\w", f"[{LETTER}]"), (r"\d", r"\p{Nd}"), (r"[\s-]", r"[\s\p{Z}\x{85}-]"),
                         (r"\s", r"[\s\p{Z}\x{85}]")):
        if short == r"\s":
            pattern = pattern.replace(r"[\s\p{Z}\x{85}-]", "<dash>").replace(short, inner)
            pattern = pattern.replace("<dash>", r"[\s\p{Z}\x{85}-]")
        else:
            pattern = pattern.replace(short, inner)
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|[^{LETTER}])" + pattern.removeprefix(r"\b").removesuffix(r"\b") + f"(?:$|[^{LETTER}])"
    return pattern


def first_match(expr: str, rules) -> str:
    whens = " ".join(f"WHEN regexp_matches({expr}, {text(wide(p))}) THEN {text(v)}" for v, p in rules)
    return f"CASE {whens} END"


CORPUS = """
corpus AS (
  SELECT doc_id, regexp_extract(text, '^[^\\n]*') AS title, text AS description,
         source AS source_type, lang AS form_type
  FROM documents)"""

TALK = f"""
talk AS (
  SELECT conv_id, turn, role AS mode,
         concat(list_extract([{', '.join(text(o) for o in OPENINGS)}],
                             CAST((conv_id * 7 + turn) % {len(OPENINGS)} AS INTEGER) + 1), ' ', text) AS query
  FROM conversations)"""

KEY = f"lower({strip('query')})"

ROUTED = f"""
routed AS (
  SELECT conv_id, turn, coalesce({first_match(KEY, intent_patterns())}, 'unknown') AS intent,
         {first_match(KEY, field_patterns(FIELD_WORDS))} AS enum_field
  FROM talk)"""

# What stands before the text of a source in a context.
SOURCE_MARK = r"\[Source \d+\]"
SOURCE_HEAD = SOURCE_MARK + r" \(score: [^)]*\)\n"

LISTS = """
lists AS (
  SELECT lang AS qid, 'source_type' AS field, source AS value, count(*) AS count,
         CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS INTEGER) AS rk
  FROM documents GROUP BY lang, source),
sums AS (SELECT qid, count(*) AS n FROM lists GROUP BY qid)"""

ANSWER = """
answers AS (
  SELECT l.qid, any_value(n) AS n,
    concat('## Complete List of source_type', chr(10), chr(10), '**Total: ', any_value(n), ' distinct values**',
      chr(10), chr(10),
      string_agg(concat(rk, '. **', value, '**', CASE WHEN count > 1 THEN concat(' — ', count, ' documents')
        ELSE ' — 1 document' END), chr(10) ORDER BY rk),
      chr(10), chr(10), '_Searched ', (SELECT format('{:,}', count(*)) FROM documents),
      ' documents in index ''documents''_') AS answer
  FROM lists l JOIN sums USING (qid) GROUP BY l.qid)"""

CENTROIDS = """
centroids AS (
  SELECT label AS qid, list(x ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x) AS x FROM (
      SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
    GROUP BY label, pos) GROUP BY label)"""


def centroid_hits(k: int, condition: str = "true", least: float | None = None, order: str | None = None) -> str:
    cut = "" if least is None else f" AND s >= {least}"
    rk = "rk"
    if order:
        rk = f"row_number() OVER (PARTITION BY qid ORDER BY {order})"
    return f"""
WITH {CENTROIDS}
SELECT qid, doc_id, round(s, 4) AS score, CAST({rk} AS INTEGER) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rk FROM (
    SELECT qid, vec_id AS doc_id, round((1 + list_cosine_similarity(v, embedding::DOUBLE[])) / 2, 12) AS s
    FROM centroids, embeddings WHERE {condition}))
WHERE rk <= {k}{cut}"""


# words of the two text fields of the corpus and of the questions
TOKENS = f"""
{CORPUS},
tokens AS MATERIALIZED (
  SELECT doc_id, field, unnest(list_filter(regexp_split_to_array(lower(body), {text(WORD_BREAK)}), lambda t: t <> ''))
    AS term
  FROM (SELECT doc_id, 'description' AS field, description AS body FROM corpus
        UNION ALL SELECT doc_id, 'title', title FROM corpus)),
asked AS MATERIALIZED (
  SELECT item_id AS qid,
         unnest(list_filter(regexp_split_to_array(lower(text), {text(WORD_BREAK)}), lambda t: t <> '')) AS term
  FROM benchmark)"""

BM25 = """
lengths AS (SELECT doc_id, field, count(*) AS dl FROM tokens GROUP BY ALL),
means AS (SELECT field, count(*) AS n, avg(dl) AS mean FROM lengths GROUP BY field),
freq AS (SELECT doc_id, field, term, count(*) AS tf FROM tokens
         WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
holders AS (SELECT field, term, count(*) AS df FROM freq GROUP BY ALL),
weight AS (
  SELECT doc_id, field, term,
         ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS w
  FROM freq JOIN lengths USING (doc_id, field) JOIN means USING (field) JOIN holders USING (field, term)),
by_words AS MATERIALIZED (
  SELECT qid, doc_id, s AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rk FROM (
    SELECT qid, doc_id, round(max(s), 9) AS s FROM (
      SELECT qid, doc_id, field, sum(w * times) AS s
      FROM (SELECT qid, term, count(*) AS times FROM asked GROUP BY ALL) JOIN weight USING (term)
      GROUP BY qid, doc_id, field) GROUP BY qid, doc_id)
  QUALIFY rk <= 200)"""

EMBED_TEXT = f"""
embed_text AS MATERIALIZED (
  SELECT doc_id, array_to_string(list_filter([a, b, c, d], lambda x: x <> ''), ' ') AS t FROM (
    SELECT doc_id, d AS a, CASE WHEN t = d THEN '' ELSE t END AS b,
           CASE WHEN f IN (d, t) THEN '' ELSE f END AS c, CASE WHEN s IN (d, t, f) THEN '' ELSE s END AS d
    FROM (SELECT doc_id, {strip('description')} AS d, {strip('title')} AS t, {strip('form_type')} AS f,
                 {strip('source_type')} AS s FROM corpus)))"""


def hashed(name: str, source: str, key: str, body: str) -> str:
    return f"""
{name}_slots AS (
  SELECT {key}, slot, count(*) AS c FROM (
    SELECT {key}, (('0x' || left(md5(term), 8))::BIGINT) % 64 AS slot FROM (
      SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({body}), {text(WORD_BREAK)}), lambda t: t <> ''))
        AS term FROM {source})) GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT {key}, slot, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT)::DOUBLE AS x FROM {name}_slots)"""


def near(asked: str, k: int) -> str:
    """The ``k`` nearest documents of every (qid, text) in ``asked``."""
    return f"""
{EMBED_TEXT},
{hashed('doc_vec', 'embed_text', 'doc_id', 't')},
{hashed('ask_vec', asked, 'qid', 'text')},
doc_norm AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM doc_vec GROUP BY doc_id),
ask_norm AS (SELECT qid, sqrt(sum(x * x)) AS n FROM ask_vec GROUP BY qid),
near AS MATERIALIZED (
  SELECT qid, doc_id, s AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rk FROM (
    SELECT qid, doc_id, round((1 + coalesce(dot, 0) / (a.n * d.n)) / 2, 12) AS s
    FROM ask_norm a CROSS JOIN doc_norm d
    LEFT JOIN (SELECT q.qid, v.doc_id, sum(q.x * v.x) AS dot FROM ask_vec q JOIN doc_vec v USING (slot) GROUP BY ALL)
      USING (qid, doc_id))
  QUALIFY rk <= {k})"""


NEAR = near("(SELECT item_id AS qid, text FROM benchmark)", 10)

MERGED = """
merged AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY branch, rk) AS merge_rk FROM (
    SELECT * FROM (SELECT qid, doc_id, score, rk, 1 AS branch FROM near
                   UNION ALL SELECT qid, doc_id, score, rk, 2 FROM by_words)
    QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY branch, rk) = 1))"""

CONTENT_KEY = f"lower({strip('title')}), lower({strip('left(description, 100)')})"

RANKED = f"""
ranked AS MATERIALIZED (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, merge_rk) AS rk FROM (
    SELECT * EXCLUDE (rk) FROM merged JOIN corpus USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY qid, {CONTENT_KEY} ORDER BY merge_rk) = 1)
  QUALIFY rk <= 30)"""

PASSAGE = f"""
passage AS (
  SELECT doc_id, array_to_string(list_filter([
    CASE WHEN {strip('description')} <> '' THEN concat('description: ', {strip('description')}) END,
    CASE WHEN {strip('title')} <> '' THEN concat('title: ', {strip('title')}) END,
    CASE WHEN {strip('form_type')} <> '' THEN concat('form_type: ', {strip('form_type')}) END],
    lambda x: x IS NOT NULL), ' | ') AS passage FROM corpus)"""


def contexts(hits: str, limit: int) -> str:
    """The packing rule, one entry at a time."""
    return f"""
{PASSAGE},
entries AS MATERIALIZED (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rk) AS i, count(*) OVER (PARTITION BY qid) AS n,
         printf('[Source %d] (score: %.4f)%s%s', rk, score, chr(10), passage) AS e
  FROM {hits} JOIN passage USING (doc_id) WHERE passage <> ''),
steps AS (
  SELECT qid, 0::BIGINT AS i, any_value(n) AS n, '' AS t, 0::BIGINT AS used, false AS done FROM entries GROUP BY qid
  UNION ALL
  SELECT qid, i, n,
    CASE WHEN skip THEN t WHEN fits THEN concat(t, gap, p)
         WHEN room > 50 THEN concat(t, gap, left(p, room), '...[truncated]') ELSE t END,
    CASE WHEN NOT skip AND fits THEN used + length(p) ELSE used END,
    done OR (NOT skip AND NOT fits AND room > 50)
  FROM (
    SELECT *, used + length(p) <= {limit} AS fits FROM (
      SELECT *, CASE WHEN NOT long THEN e
        WHEN bar > 0 AND length(cut) - bar - 2 > length(cut) * 0.5
          THEN concat(left(cut, length(cut) - bar - 2), chr(10), '...[truncated]')
        ELSE concat(cut, chr(10), '...[truncated]') END AS p FROM (
        SELECT *, instr(reverse(cut), ' | ') AS bar FROM (
          SELECT s.qid, s.i + 1 AS i, s.n, t, used, done, e, {limit} - used AS room, done OR used >= {limit} AS skip,
                 CASE WHEN t = '' THEN '' ELSE concat(chr(10), chr(10)) END AS gap,
                 length(e) > {limit} // s.n AND {limit} - used > 100 AS long,
                 left(e, least({limit} // s.n, {limit} - used)) AS cut
          FROM steps s JOIN entries x ON x.qid = s.qid AND x.i = s.i + 1))))),
contexts AS MATERIALIZED (SELECT qid, t AS context FROM steps WHERE i = n)"""


CHUNKS = r"""
parts AS MATERIALIZED (
  SELECT qid, generate_subscripts(ps, 1) AS i, len(ps) AS n, unnest(ps) AS p FROM (
    SELECT qid, string_split(regexp_replace(context, '(\[Source \p{Nd}+\] )', chr(1) || '\1', 'g'), chr(1)) AS ps
    FROM contexts)),
packing AS (
  SELECT qid, 0::BIGINT AS i, any_value(n) AS n, ''::VARCHAR AS open, []::VARCHAR[] AS closed FROM parts GROUP BY qid
  UNION ALL
  SELECT s.qid, s.i + 1, s.n,
    CASE WHEN length(open) + length(p) > 3000 AND open <> '' THEN p ELSE concat(open, p) END,
    CASE WHEN length(open) + length(p) > 3000 AND open <> '' THEN list_append(closed, open) ELSE closed END
  FROM packing s JOIN parts x ON x.qid = s.qid AND x.i = s.i + 1),
packed AS (
  SELECT qid, CASE WHEN open <> '' THEN list_append(closed, open) ELSE closed END AS cs FROM packing WHERE i = n)"""


def values_of(pairs: str, table: str, caps: str) -> str:
    return f"""
WITH long AS (SELECT unnest([{pairs}]) AS c FROM {table}),
counts AS (SELECT c.field AS field, c.value AS value, count(*) AS count FROM long
           WHERE c.value IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS INTEGER) AS rk,
                  count(*) OVER (PARTITION BY field) AS total_unique FROM counts),
capped AS (SELECT *, CASE field {caps} END AS cap FROM ranked)
"""


def pairs(*fields: str) -> str:
    return ", ".join(f"struct_pack(field := '{f}', value := CAST({f} AS VARCHAR))" for f in fields)


MULTI = (
    "SELECT field, value, count, rk, total_unique, least(total_unique, cap) AS returned, "
    "least(total_unique, cap) < cap AS is_complete FROM capped WHERE rk <= cap"
)

NEW_VECTORS = """
fresh AS (SELECT vec_id * 2 AS vec_id, label + 100 AS label, list_reverse(embedding)[1] AS first FROM embeddings)"""

QUESTION_SQL = f"""
SELECT conv_id, turn, {strip('query')} AS query,
       CASE WHEN turn = 0 THEN 'answer' ELSE mode END AS mode,
       concat('{{"form_type":"', mode, '"}}') AS filters,
       CASE WHEN {strip('query')} = '' THEN 'Please enter a query'
            WHEN turn <> 0 THEN concat('Invalid mode: ', mode) END AS problem
FROM talk"""


def _strategy() -> str:
    whens = []
    for intents, needs, strategy, confidence in STRATEGIES:
        names = ", ".join(text(i) for i in intents)
        field = " AND enum_field IS NOT NULL" if needs else ""
        whens.append((f"WHEN intent IN ({names}){field} THEN ", strategy, confidence))
    return (
        "CASE " + " ".join(f"{w}{text(s)}" for w, s, _ in whens) + " ELSE 'knn_single' END AS strategy, "
        "CASE " + " ".join(f"{w}{c}::DOUBLE" for w, _, c in whens) + " ELSE 0.4::DOUBLE END AS confidence"
    )


ORACLE = {
    "terms_agg": """
SELECT p_brand AS value, count(*) AS count,
       CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS rk
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count DESC, value LIMIT 200""",
    "terms_agg_filtered": """
SELECT p_brand AS value, count(*) AS count,
       CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS rk
FROM part WHERE p_brand IS NOT NULL AND p_type = 'ECONOMY'
GROUP BY p_brand ORDER BY count DESC, value LIMIT 200""",
    "terms_agg_capped": values_of(pairs("o_custkey"), "orders", "WHEN 'o_custkey' THEN 10") + MULTI,
    "terms_agg_least": """
SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS count,
       CAST(row_number() OVER (ORDER BY count(*), CAST(l_suppkey AS VARCHAR)) AS INTEGER) AS rk
FROM lineitem GROUP BY l_suppkey ORDER BY count, value LIMIT 5""",
    "distinct_count": """
SELECT 'p_brand' AS field, count(DISTINCT p_brand) AS total_unique FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part
UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part""",
    "multi_terms_agg": values_of(
        pairs("p_brand", "p_type", "p_name"), "part", "WHEN '' THEN 0 ELSE 200") + MULTI,
    "facets": f"WITH {CORPUS}, x AS (" + values_of(
        pairs("source_type", "form_type", "title"), "corpus", "WHEN 'title' THEN 100 ELSE 50")
        + "SELECT * FROM capped WHERE rk <= cap) "
        "SELECT field, string_agg(value, '|' ORDER BY rk) AS options FROM x GROUP BY field",
    "distribution": """
SELECT value, count, round(count * 100.0 / sum(count) OVER (), 4)::DOUBLE AS percent,
       CAST(row_number() OVER (ORDER BY count DESC, value) AS INTEGER) AS rk
FROM (SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1)""",
    "coverage": values_of(
        pairs("p_brand", "p_type", "p_name"), "part", "WHEN 'p_brand' THEN 10 WHEN 'p_type' THEN 50 ELSE 20 ") + """
SELECT field, any_value(total_unique) AS total_unique, any_value(least(total_unique, cap)) AS returned,
       any_value(least(total_unique, cap) < cap) AS is_complete,
       any_value(CASE WHEN least(total_unique, cap) < cap THEN 100.0
                 ELSE round_even(least(least(total_unique, cap) * 100.0 / total_unique, 95), 0) END)::DOUBLE AS percent
FROM capped GROUP BY field""",
    "terms_for_questions": f"WITH {LISTS} SELECT * FROM lists",
    "agg_context": f"""
WITH {LISTS}
SELECT qid, concat('Complete list of ', any_value(n), ' distinct source_type values found in the index:', chr(10),
  chr(10), string_agg(concat('  ', rk, '. ', value, CASE WHEN count > 1 THEN concat(' (', count, ' documents)')
  ELSE ' (1 document)' END), chr(10) ORDER BY rk)) AS context
FROM lists JOIN sums USING (qid) GROUP BY qid""",
    "enumeration_report": f"""
WITH {LISTS}, {ANSWER}
SELECT qid, answer, n AS total_unique, n AS returned, true AS is_complete FROM answers""",
    "build_reports": f"""
WITH {LISTS}, {ANSWER}
SELECT qid, concat('📋 Enumeration: source_type (', n, ' values)') AS title, 'answer' AS mode,
       'Enumeration' AS mode_label, 'List all sources' AS query, answer, 'direct_enumeration' AS strategy,
       'enumeration' AS intent, true AS is_enumeration, (SELECT count(*) FROM documents) AS index_total_docs,
       n AS total_unique, qid AS form_type
FROM answers""",
    "list_reports": f"""
WITH {LISTS}
SELECT concat('📋 Enumeration: source_type (', n, ' values)') AS title, 'answer' AS mode,
       'List all sources' AS query, 0::BIGINT AS total_hits FROM sums""",
    "saved_reports": f"""
WITH {LISTS}, one AS (SELECT * FROM sums ORDER BY qid LIMIT 1),
both_ways AS (SELECT 'listed' AS way, n FROM sums, range(2) UNION ALL SELECT 'found', n FROM one)
SELECT way, concat('📋 Enumeration: source_type (', n, ' values)') AS title, 'List all sources' AS query FROM both_ways""",
    "load_report": f"""
WITH {LISTS}, {ANSWER}
SELECT qid, concat('📋 Enumeration: source_type (', n, ' values)') AS title, answer
FROM answers ORDER BY qid LIMIT 1""",
    "classify": f"WITH {TALK}, {ROUTED} SELECT conv_id, turn, intent FROM routed",
    "resolve_field": f"WITH {TALK}, {ROUTED} SELECT conv_id, turn, enum_field FROM routed",
    "resolve_by_rules": f"""
WITH {TALK},
b AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS word FROM benchmark),
rules AS (SELECT word, count(*) AS n, min(item_id) AS item FROM b WHERE word <> '' GROUP BY word),
asked AS (SELECT row_number() OVER () AS r, * FROM talk),
w AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+')) AS word FROM asked),
hit AS (SELECT r, arg_min(item, n * 1000000 + item) AS item FROM w JOIN rules USING (word) GROUP BY r)
SELECT conv_id, turn, 'item ' || item AS enum_field FROM asked LEFT JOIN hit USING (r)""",
    "route": f"WITH {TALK}, {ROUTED} SELECT conv_id, turn, intent, enum_field, {_strategy()} FROM routed",
    "check_questions": f"WITH {TALK} {QUESTION_SQL}",
    "parse_filters": """
SELECT p_partkey, p_brand AS brand, concat('a=', p_type) AS expr, CAST(p_size AS VARCHAR) AS size, '' AS brand2,
       4 AS entries FROM part""",
    "apply_filters": """
SELECT concat('[{"key":"form_type","value":"', lang, '"}]') AS spec, doc_id FROM documents""",
    "knn_topk": centroid_hits(10),
    "knn_approx": centroid_hits(10),
    "knn_one_scan": centroid_hits(10),
    "knn_index": """
SELECT 5 * count(*) FILTER (vec_id % 20 = 0) AS wanted, 5 * count(*) FILTER (vec_id % 20 = 0) AS found, true AS recall_ok,
       count(*) AS indexed, true AS share_ok
FROM embeddings""",
    "knn_filtered": centroid_hits(10, "label = qid"),
    "knn_min_score": centroid_hits(50, least=0.7),
    "knn_recent": centroid_hits(10, order="doc_id DESC"),
    "term_statistics": f"""
WITH {TOKENS}
SELECT field, term, count(DISTINCT doc_id) AS docs, 0::BIGINT AS words FROM tokens GROUP BY field, term
UNION ALL SELECT field, '', count(DISTINCT doc_id), count(*) FROM tokens GROUP BY field""",
    "lexical_bm25": f"""
WITH {TOKENS}, {BM25}
SELECT qid, doc_id, round(score, 4) AS score, CAST(rk AS INTEGER) AS rk FROM by_words""",
    "lexical_index": f"""
WITH {TOKENS}, {BM25}
SELECT qid, doc_id, round(score, 4) AS score, CAST(rk AS INTEGER) AS rk FROM by_words""",
    "filtered_page": """
SELECT lang AS qid, doc_id, 0.0::DOUBLE AS score,
       CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS rk
FROM documents QUALIFY rk <= 200""",
    "embed_documents": f"""
WITH {CORPUS}, {EMBED_TEXT}, {hashed('doc_vec', 'embed_text', 'doc_id', 't')}
SELECT doc_id, true AS embed_ok, CAST(slot AS INTEGER) AS at, round(x, 5) AS x FROM doc_vec""",
    "hybrid_merge": f"""
WITH RECURSIVE {TOKENS}, {BM25}, {NEAR}, {MERGED}
SELECT qid, doc_id, round(score, 4) AS score, CAST(branch AS INTEGER) AS branch,
       CAST(merge_rk AS INTEGER) AS merge_rk FROM merged""",
    "rank_hits": f"""
WITH {TOKENS}, {BM25}, {NEAR}, {MERGED}, {RANKED}
SELECT qid, doc_id, round(score, 4) AS score, CAST(rk AS INTEGER) AS rk FROM ranked""",
    "fuse_hits": f"""
WITH {TOKENS}, {BM25}, {NEAR},
either AS (SELECT qid, doc_id, rk FROM near UNION ALL SELECT qid, doc_id, rk FROM by_words),
fused AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rk)), 12) AS score, min(rk) AS lead, count(*) AS n FROM either GROUP BY ALL)
SELECT qid, doc_id, round(score, 9) AS score,
       CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, lead, doc_id) AS INTEGER) AS rk, CAST(n AS INTEGER) AS n_lists
FROM fused QUALIFY rk <= 30""",
    "distinct_sketches": "".join(f"""
{'UNION ALL ' if i else ''}SELECT '{f}' AS field, count(DISTINCT {f}) AS exact, true AS within_error FROM lineitem"""
        for i, f in enumerate(("l_orderkey", "l_partkey", "l_suppkey"))),
    "dedup_content": f"""
WITH {CORPUS}
SELECT doc_id FROM corpus QUALIFY row_number() OVER (PARTITION BY {CONTENT_KEY} ORDER BY doc_id) = 1""",
    "dedup_field": f"""
WITH {CORPUS}
SELECT form_type, doc_id FROM corpus
QUALIFY row_number() OVER (PARTITION BY form_type, lower({strip('title')}) ORDER BY doc_id) = 1""",
    "uncovered_values": f"""
WITH {CORPUS}
SELECT title AS value, count(*) AS count FROM corpus
WHERE title IS NOT NULL AND lower(title) NOT IN (
  SELECT lower({strip('title')}) FROM corpus JOIN labels USING (doc_id) WHERE toxic = 0 AND {strip('title')} <> '')
GROUP BY title""",
    "citations": f"""
WITH {CORPUS}, {NEAR}
SELECT qid, CAST(rk AS INTEGER) AS idx, round(score, 4) AS score, CAST(doc_id AS VARCHAR) AS id, title,
       left(description, 200) AS description, '' AS activity, '' AS location, form_type AS type
FROM near JOIN corpus USING (doc_id)""",
    "embedding_text": f"""
WITH {CORPUS}, {EMBED_TEXT}
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM embed_text WHERE t <> ''""",
    "passages": f"""
WITH {CORPUS}, {PASSAGE}
SELECT doc_id, CAST(length(passage) AS INTEGER) AS chars, md5(passage) AS digest FROM passage WHERE passage <> ''""",
    "preview_text": f"""
WITH {CORPUS}, {EMBED_TEXT}
SELECT doc_id, CAST(length(t) AS INTEGER) AS text_chars, left(t, 200) AS preview
FROM embed_text ORDER BY doc_id LIMIT 3""",
    "build_context": f"WITH RECURSIVE {CORPUS}, {NEAR}, {contexts('near', 8000)} SELECT qid, context FROM contexts",
    "chunk_context": f"""
WITH RECURSIVE {TOKENS}, {BM25}, {NEAR}, {MERGED}, {RANKED}, {contexts('ranked', 32000)}, {CHUNKS}
SELECT qid, CAST(unnest(range(1, least(len(cs), 8) + 1)) AS INTEGER) AS chunk_no, unnest(cs[1:8]) AS chunk,
       CAST(least(len(cs), 8) AS INTEGER) AS n_chunks, CAST(greatest(len(cs) - 8, 0) AS INTEGER) AS n_dropped
FROM packed""",
    "corpus_count": "SELECT count(*) AS docs FROM documents",
    "build_vector_table": f"""
WITH {CORPUS}, marked AS (
  SELECT doc_id, title, description, source_type,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN concat('labelled ', form_type) ELSE form_type END
           AS form_type FROM corpus), {EMBED_TEXT.replace("FROM corpus", "FROM marked")}
SELECT doc_id, form_type, true AS embed_ok, CAST(least(length(t), 10000) AS INTEGER) AS stored_chars
FROM embed_text JOIN marked USING (doc_id) WHERE t <> ''""",
    "fixed_chunks": """
WITH w AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_brand, p_type]) AS ws FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS no, array_to_string(ws[i * 3 + 1 : i * 3 + 3], ',') AS items
FROM (SELECT p_partkey, ws, unnest(range((len(ws) + 2) // 3)) AS i FROM w)""",
    "build_prompts": f"""
WITH RECURSIVE {CORPUS}, {NEAR}, {contexts('near', 8000)}
SELECT qid, concat({text(MODE_INSTRUCTIONS['answer'] + ' ' + ALWAYS)}, chr(10), chr(10), {text(synthesis.PASSAGES)}, chr(10), context,
  chr(10), chr(10), {text(synthesis.QUESTION)}, chr(10), text, chr(10), chr(10), {text(synthesis.REPORT)}, chr(10),
  {text(synthesis.ASK_SINGLE)}) AS prompt
FROM contexts JOIN benchmark ON item_id = qid""",
    # The wording stands here in full, apart from the engine's.
    "prompt_kinds": """
WITH b AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, concat('About line ', turn) AS q,
         list_extract(['answer', 'analyze', 'predict', 'summarize', 'other'], CAST((conv_id + turn) % 5 AS INTEGER) + 1) AS mode
  FROM conversations),
asked AS (
  SELECT *, concat(CASE mode
      WHEN 'analyze' THEN 'Explain what the numbered texts below have in common and where they part, with the numbers of the texts.'
      WHEN 'predict' THEN
        'Give an outlook on the question. Keep apart what the numbered texts below report and what you conclude.'
      WHEN 'summarize' THEN 'Shorten the numbered texts below to what someone needs to know who will not read them.'
      ELSE 'Reply to the question. Use the numbered texts and the lists below only, and give the number of the text you rely on.'
    END, ' If a note says that something is missing, pass it on.') AS told,
    concat(chr(10), chr(10), '[Notes]', chr(10), '- a list was cut', chr(10), '- mode ', mode, chr(10), 'Pass these notes on.') AS notes,
    concat(chr(10), chr(10)) AS gap, concat(chr(10), chr(10), '[Question]', chr(10), q, chr(10), chr(10)) AS question
  FROM b)
SELECT conv_id, turn, mode, 'lists' AS kind, concat(told, gap, '[Lists]', chr(10), text, question, '[Reply]', chr(10),
  'Say how the documents are spread over the values, and keep all counts and shares.') AS prompt FROM asked
UNION ALL SELECT conv_id, turn, mode, 'short', concat(told, gap, '[Texts]', chr(10), text, question, '[Reply]', chr(10),
  'Keep it short, with marks like [Source 1].') FROM asked
UNION ALL SELECT conv_id, turn, mode, 'whole', concat(told, notes, gap, '[Texts]', chr(10), text, question, '[Reply]', chr(10),
  'Begin with the outcome, then give the grounds.') FROM asked
UNION ALL SELECT conv_id, turn, mode, 'bare', concat(told, gap, '[Texts]', chr(10), text, question, '[Reply]', chr(10),
  'Begin with the outcome, then give the grounds.') FROM asked
UNION ALL SELECT conv_id, turn, mode, 'share', concat(told, gap, 'The texts come in 4 shares; this is number 2.', gap,
  '[Texts, share 2 of 4]', chr(10), text, question, '[Step]', chr(10),
  'Note what this share says about the question. The notes on all shares are put together later.') FROM asked
UNION ALL SELECT conv_id, turn, mode, 'last', concat(told, notes, gap, '[Written about shares 1 to 3]', chr(10), 'noted ', text, gap,
  '[Texts, last share: 4 of 4]', chr(10), text, question, '[Step]', chr(10),
  'Put the notes and the last share together into one text, with marks like [Source 1].') FROM asked""",
    # The offline writer's answer to a chunk: the first sentence of each source in it, marked.
    "synthesize": f"""
WITH RECURSIVE {TOKENS}, {BM25}, {NEAR}, {MERGED}, {RANKED}, {contexts('ranked', 32000)}, {CHUNKS},
chunks AS (
  SELECT qid, least(len(cs), 8) AS n, unnest(range(1, least(len(cs), 8) + 1)) AS no, unnest(cs[1:8]) AS chunk FROM packed),
pieces AS (
  SELECT qid, n, no, unnest(range(len(ps))) AS i, unnest(ps) AS p
  FROM (SELECT *, string_split(chunk, concat(chr(10), chr(10), '[Source ')) AS ps FROM chunks)),
sources AS (SELECT qid, n, no, i, CASE WHEN i = 0 THEN p ELSE concat('[Source ', p) END AS s FROM pieces),
bodies AS (
  SELECT qid, n, no, i, regexp_matches(s, '{SOURCE_HEAD}') AS told, regexp_extract(s, '({SOURCE_MARK}) ', 1) AS mark,
         {strip("regexp_replace(s, '(?s)^.*?" + SOURCE_HEAD + "', '')")} AS body
  FROM sources),
answers AS (
  SELECT qid, n, no, coalesce(string_agg(concat(
    CASE WHEN regexp_matches(body, '(?s)^.*?[.!?][ \n]') THEN regexp_extract(body, '(?s)^(.*?[.!?])[ \n]', 1) ELSE body END,
    ' ', mark), chr(10) ORDER BY i) FILTER (told), '') AS answer
  FROM bodies GROUP BY qid, n, no)
SELECT qid, CASE WHEN n <= 3 THEN string_agg(answer, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY no)
                 ELSE any_value(answer) FILTER (no = n) END AS answer
FROM answers JOIN benchmark ON item_id = qid GROUP BY qid, n""",
    "try_search": f"""
WITH {CORPUS}, {near("(SELECT 0 AS qid, 'the tion of here' AS text)", 3)}
SELECT doc_id, round(score, 4) AS score, CAST(rk AS INTEGER) AS rk FROM near""",
    "upsert_vectors": f"""
WITH {NEW_VECTORS}
SELECT vec_id, label, round(first::DOUBLE, 5) AS first FROM fresh
UNION ALL SELECT vec_id, label, round(embedding[1]::DOUBLE, 5) FROM embeddings
WHERE vec_id NOT IN (SELECT vec_id FROM fresh)""",
    "verify_vectors": """
SELECT count(*) AS docs, count(*) FILTER (len(embedding) <> 64) AS wrong_length,
       count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero_vectors, 0::BIGINT AS no_text
FROM embeddings""",
    "ingest_report": f"""
WITH {CORPUS}, {EMBED_TEXT},
counts AS (SELECT CASE WHEN contains(t, '|') THEN 'error' ELSE 'indexed' END AS status, count(*) AS docs
           FROM embed_text WHERE t <> '' GROUP BY 1)
SELECT status, docs, round(docs * 100.0 / sum(docs) OVER (), 1)::DOUBLE AS percent FROM counts""",
}

ORACLE["bucketed_vector_table"] = ORACLE["build_vector_table"]
ORACLE["facets_indexed"] = ORACLE["facets"]
ORACLE["terms_indexed"] = ORACLE["terms_for_questions"]
ORACLE["top_values"] = """
SELECT w AS value, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, w) AS INTEGER) AS rk
FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w QUALIFY rk <= 100"""
