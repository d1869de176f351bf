"""The same results in SQL, where SQL can express the operator."""

# Spans lie between the pieces that splitting at the matches leaves.
OP6 = r"""
WITH rules(kind, place, pattern, grp, least) AS (VALUES
    ('assign', 1, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 12),
    ('access', 2, 'AKIA[A-Z0-9]+', 0, 18),
    ('hex', 3, '[0-9a-f]{16,}', 0, 16)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
    SELECT r, 'assign' AS kind, string_split_regex(t, p) AS gaps, regexp_extract_all(t, p) AS whole,
        regexp_extract_all(t, p, 1) AS grp, 1 AS place, 12 AS least
    FROM d, (SELECT pattern AS p FROM rules WHERE place = 1) WHERE regexp_matches(t, p)
    UNION ALL
    SELECT r, kind, string_split_regex(t, pattern), regexp_extract_all(t, pattern), regexp_extract_all(t, pattern),
        place, least
    FROM d, rules WHERE place > 1 AND regexp_matches(t, pattern)),
s AS (SELECT r, kind, place, least, gaps, whole, grp, unnest(range(1, len(whole) + 1)) AS i FROM m),
spans AS (
    SELECT r, kind, place,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)
            AS b,
        length(whole[i]) AS n
    FROM s WHERE length(grp[i]) >= least),
g AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, place) AS spans
    FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

# Lines, runs of lines of one level, units of quoted and own words, then the latest earlier message with an equal unit.
OP3 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text, coalesce(text, '') AS t FROM conversations),
raw AS (
    SELECT r, unnest(string_split_regex(t, '\r?\n')) AS line, generate_subscripts(string_split_regex(t, '\r?\n'), 1) AS i FROM m),
l AS (
    SELECT r, i, len(regexp_replace(regexp_extract(line, '^\s{0,3}(?:>\s?)+'), '[^>]', '', 'g')) AS depth,
        regexp_replace(line, '^\s{0,3}(?:>\s?)+', '') AS b
    FROM raw),
o AS (
    SELECT *, lead(depth, 1, 0) OVER (PARTITION BY r ORDER BY i) AS below, lag(depth, 1, -1) OVER (PARTITION BY r ORDER BY i) AS above
    FROM l),
bodies AS (
    SELECT r, max(depth) AS quote_depth, regexp_replace(coalesce(string_agg(b, chr(10) ORDER BY i) FILTER (depth = 0 AND NOT (below > 0
        AND regexp_matches(b, '(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió)(?:[^a-z].*)?:\s*$'))), ''),
        '^\s+|\s+$', '', 'g') AS body
    FROM o GROUP BY r),
p AS (SELECT *, sum(CASE WHEN depth <> above THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS passage FROM o),
quotes AS (SELECT r, passage, depth, string_agg(b, chr(10) ORDER BY i) AS q FROM p WHERE depth > 0 GROUP BY ALL),
texts AS (SELECT r, passage, depth, q AS x, true AS quoted FROM quotes UNION ALL SELECT r, 0, 0, body, false FROM bodies),
parts AS (
    SELECT r, passage, depth, quoted, 0 AS kind, x AS u FROM texts
    UNION ALL SELECT r, passage, depth, quoted, 1, unnest(string_split_regex(x, '\n\s*\n')) FROM texts
    UNION ALL SELECT r, passage, depth, quoted, 2, unnest(string_split(x, chr(10))) FROM texts
    UNION ALL SELECT r, passage, depth, quoted, 3, unnest(string_split_regex(x, '\n\s*\n|[.!?…]+[ \t\r\n]+|[。！？]+')) FROM texts),
units AS (
    SELECT r, passage, depth, quoted, kind, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS u FROM parts),
good AS (
    SELECT units.*, conv_id, turn FROM units JOIN m USING (r)
    WHERE u <> '' AND (NOT quoted OR kind < 2 OR len(string_split(u, ' ')) >= 3) AND conv_id IS NOT NULL AND turn IS NOT NULL),
links AS (
    SELECT q.r, q.passage, q.depth, q.kind, max(s.turn) AS source
    FROM good q JOIN good s ON q.conv_id = s.conv_id AND q.u = s.u AND s.turn < q.turn
    WHERE q.quoted AND NOT s.quoted GROUP BY ALL),
best AS (
    SELECT r, source AS reply_to, count(DISTINCT passage) OVER (PARTITION BY r) AS n_linked
    FROM links QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth, kind, source DESC) = 1),
counts AS (SELECT r, count(*) AS n FROM quotes GROUP BY r),
replies AS (SELECT conv_id, turn, min(reply_to) AS up FROM best JOIN m USING (r) GROUP BY ALL),
chain AS (
    SELECT conv_id, turn, up AS thread FROM replies
    UNION ALL SELECT c.conv_id, c.turn, x.up FROM chain c JOIN replies x ON x.conv_id = c.conv_id AND x.turn = c.thread),
threads AS (SELECT conv_id, turn, min(thread) AS thread FROM chain GROUP BY ALL)
SELECT m.conv_id, coalesce(h.thread, m.turn) AS thread, m.turn, m.role, body,
    concat('<|', coalesce(m.role, 'unknown'), '|>', chr(10), body, chr(10)) AS rendered, CAST(quote_depth AS BIGINT) AS quote_depth,
    CASE WHEN m.conv_id IS NULL OR m.turn IS NULL THEN 0 ELSE coalesce(n, 0) END AS n_passages, coalesce(n_linked, 0) AS n_linked, reply_to
FROM m JOIN bodies USING (r) LEFT JOIN counts USING (r) LEFT JOIN best USING (r)
LEFT JOIN threads h ON h.conv_id = m.conv_id AND h.turn = m.turn
"""

# Every window that begins at a shingle of an item of its size (or is the document's last) against every such item, bag by bag.
OP7 = r"""
WITH i AS (
    SELECT item_id, words, len(words) AS n, least(len(words), 5) AS w FROM (
        SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM benchmark)
    WHERE len(words) > 0),
ish AS (SELECT item_id, n, w, unnest(list_transform(range(1, n - w + 2), lambda k: array_to_string(words[k:k + w - 1], ' '))) AS g FROM i),
ibag AS (SELECT item_id, n, w, g, count(*) AS c FROM ish GROUP BY ALL),
d AS (
    SELECT r, doc_id, words, len(words) AS m FROM (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words
        FROM (SELECT DISTINCT doc_id, text FROM documents))),
p AS (SELECT r, doc_id, m, w, words, unnest(range(0, m - w + 1)) AS pos FROM d, (SELECT DISTINCT w FROM i) WHERE m >= w),
dsh AS MATERIALIZED (SELECT r, doc_id, m, w, pos, array_to_string(words[pos + 1:pos + w], ' ') AS g FROM p),
starts AS (
    SELECT DISTINCT r, doc_id, w, n, least(n, m) AS size, least(pos, greatest(m - n, 0)) AS st
    FROM dsh JOIN (SELECT DISTINCT n, w, g FROM ish) USING (w, g)),
wbag AS (
    SELECT s.r, s.doc_id, s.w, s.n, s.size, s.st, x.g, count(*) AS c
    FROM starts s JOIN dsh x ON x.r = s.r AND x.w = s.w AND x.pos BETWEEN s.st AND s.st + s.size - s.w GROUP BY ALL),
met AS (
    SELECT r, doc_id, item_id, n, w, size, st, sum(least(wbag.c, ibag.c)) AS shared FROM wbag JOIN ibag USING (n, w, g) GROUP BY ALL),
sim AS (
    SELECT *, CAST(shared AS DOUBLE) / CAST((size - w + 1) + (n - w + 1) - shared AS DOUBLE) AS similarity FROM met)
SELECT doc_id, item_id, similarity, CAST(st AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, st) = 1
"""

# Base 32 by groups of 20 bits: five hexadecimal digits are four letters.
OP8 = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT *, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS largest FROM p),
g AS (SELECT r, i, CAST(concat('0x', substr(h, i * 5 + 1, 5)) AS INTEGER) AS v FROM d, range(8) AS x(i)),
b AS (
    SELECT r, string_agg(concat(
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1),
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)),
        '' ORDER BY i) AS payload_digest
    FROM g GROUP BY r)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM d JOIN b USING (r)
"""

# Words with their piece and place; phrases by looking one and two words ahead. Products pass 64 bits, hence HUGEINT.
OP13 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
p AS (SELECT r, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece,
        generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS i FROM d),
w AS (
    SELECT r, lang, i, unnest(words) AS w1, generate_subscripts(words, 1) AS j
    FROM (SELECT r, lang, i, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p)),
o AS (SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY r, i ORDER BY j)),
f1 AS (SELECT lang, w1 AS phrase, count(*)::HUGEINT AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS phrase, count(*)::HUGEINT AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (
    SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*)::HUGEINT AS f FROM o WHERE w3 IS NOT NULL
    GROUP BY ALL HAVING count(*) >= 10),
c AS (
    SELECT lang, phrase, f AS a, w1 AS fst, w2 AS rst, 1 AS k FROM f2 WHERE NOT EXISTS (
        SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND 100 * f3.f >= 50 * f2.f
            AND ((f3.w1 = f2.w1 AND f3.w2 = f2.w2) OR (f3.w2 = f2.w1 AND f3.w3 = f2.w2)))
    UNION ALL SELECT lang, phrase, f, w1, w2 || ' ' || w3, 1 FROM f3
    UNION ALL SELECT lang, phrase, f, w1 || ' ' || w2, w3, 2 FROM f3),
f AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, f FROM f2),
s AS (
    SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, k, (1000000 * a * a) // (x.f * y.f) AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.phrase = fst JOIN f y ON y.lang = c.lang AND y.phrase = rst),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
    r::BIGINT AS r, n, score::BIGINT AS score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op3_quotation_linking": OP3,
    "op6_secret_ledger": OP6,
    "op7_decontamination": OP7,
    "op8_warc_seekable": OP8,
    "op13_phrase_collocations": OP13,
}
