"""SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from leafmill.functions.text import WHITE_SPACE

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, block_order ORDER BY loaded_at DESC, block_row DESC) AS n FROM blocks) WHERE n = 1),
items AS (SELECT document_id, block_order AS seq, lower(replace(trim(block_type, '{ws}'), '-', '_')) AS kind, text, page_number AS page_no, heading_level AS item_level, caption FROM latest)"""
_TYPED = (
    _LATEST
    + """,
typed AS (SELECT * FROM (SELECT document_id, seq, page_no AS page_number, kind AS block_type,
  CASE WHEN kind = 'figure' THEN coalesce(nullif(trim(coalesce(caption, ''), '{ws}'), ''), '[Figure]') ELSE trim(text, '{ws}') END AS text, item_level, coalesce(caption, '') AS caption
  FROM items WHERE page_no IS NOT NULL) WHERE block_type = 'figure' OR text <> ''),
levelled AS (SELECT *, CASE WHEN block_type = 'heading' THEN coalesce(CASE WHEN regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)\\b', 1) <> '' THEN len(string_split(regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)\\b', 1), '.')) END, item_level, 1) END AS heading_level FROM typed),
blk AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) - 1 AS block_order, count(*) FILTER (block_type = 'heading') OVER (PARTITION BY document_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS h FROM levelled)"""
)
_PATHS = (
    _TYPED
    + """,
heads AS (SELECT document_id, h AS sid, text, heading_level AS lev FROM blk WHERE block_type = 'heading'),
headpaths AS (SELECT b.document_id, b.sid, list(a.text ORDER BY a.sid) AS path FROM heads b JOIN heads a ON a.document_id = b.document_id AND a.sid <= b.sid
  WHERE NOT EXISTS (SELECT 1 FROM heads m WHERE m.document_id = b.document_id AND m.sid > a.sid AND m.sid <= b.sid AND m.lev <= a.lev) GROUP BY b.document_id, b.sid),
pathed AS (SELECT blk.*, CASE WHEN block_type = 'title' THEN [] ELSE coalesce(p.path, []) END AS path FROM blk LEFT JOIN headpaths p ON p.document_id = blk.document_id AND p.sid = blk.h)"""
)
_RUNS = (
    _PATHS
    + """,
flagged AS (SELECT *, block_type IN ('table', 'figure', 'formula', 'code') AS is_atomic, lag(block_type IN ('table', 'figure', 'formula', 'code')) OVER w AS atomic_before, lag(path) OVER w AS path_before, row_number() OVER w AS page_row
  FROM pathed WINDOW w AS (PARTITION BY document_id, page_number ORDER BY block_order)),
runs AS (SELECT *, sum(CASE WHEN is_atomic OR page_row = 1 OR atomic_before OR path IS DISTINCT FROM path_before THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY block_order ROWS UNBOUNDED PRECEDING) AS run FROM flagged)"""
)
_PARAGRAPHS = (
    _RUNS
    + """,
para AS (SELECT document_id, page_number, run, path, block_order, text, len(regexp_extract_all(text, '\\S+')) AS k, row_number() OVER (PARTITION BY document_id, page_number, run ORDER BY block_order) AS i FROM runs WHERE NOT is_atomic),
pfold AS (SELECT document_id, page_number, run, i, k, 0 AS g, CASE WHEN k > {pmax} THEN 0 ELSE k END AS used, k > {pmax} AS large FROM para WHERE i = 1
  UNION ALL SELECT p.document_id, p.page_number, p.run, p.i, p.k, CASE WHEN p.k > {pmax} OR f.large OR f.used + p.k > {pmax} THEN f.g + 1 ELSE f.g END,
  CASE WHEN p.k > {pmax} THEN 0 WHEN f.large OR f.used + p.k > {pmax} THEN p.k ELSE f.used + p.k END, p.k > {pmax}
  FROM pfold f JOIN para p ON p.document_id = f.document_id AND p.page_number = f.page_number AND p.run = f.run AND p.i = f.i + 1),
pgroups AS (SELECT p.*, f.g, f.large FROM para p JOIN pfold f ON p.document_id = f.document_id AND p.page_number = f.page_number AND p.run = f.run AND p.i = f.i)"""
)
_SPLIT = "list_filter(list_transform(regexp_extract_all({t}, '(?s).*?[.!?]+(?:\\s+|$)|.+$'), lambda s: trim(s, '{ws}')), lambda s: s <> '')"
_WINDOWS = "unnest(list_transform(range(0, len({w}), {m}), lambda s: array_to_string({w}[s + 1 : s + {m}], ' ')))"
_SECTION = (
    _PARAGRAPHS
    + """,
small AS (SELECT document_id, page_number, run, any_value(path) AS path, g, 0 AS sg, 0 AS piece, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM pgroups WHERE NOT large GROUP BY document_id, page_number, run, g),
slist AS (SELECT document_id, page_number, run, path, g, """
    + _SPLIT.replace("{t}", "text")
    + """ AS s FROM pgroups WHERE large),
sent AS (SELECT document_id, page_number, run, path, g, unnest(s) AS text, generate_subscripts(s, 1) AS i FROM slist),
sents AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS k FROM sent),
sfold AS (SELECT document_id, page_number, run, g, i, k, 0 AS sg, CASE WHEN k > {pmax} THEN 0 ELSE k END AS used, k > {pmax} AS large FROM sents WHERE i = 1
  UNION ALL SELECT p.document_id, p.page_number, p.run, p.g, p.i, p.k, CASE WHEN p.k > {pmax} OR f.large OR f.used + p.k > {pmax} THEN f.sg + 1 ELSE f.sg END,
  CASE WHEN p.k > {pmax} THEN 0 WHEN f.large OR f.used + p.k > {pmax} THEN p.k ELSE f.used + p.k END, p.k > {pmax}
  FROM sfold f JOIN sents p ON p.document_id = f.document_id AND p.page_number = f.page_number AND p.run = f.run AND p.g = f.g AND p.i = f.i + 1),
sgroups AS (SELECT p.*, f.sg, f.large FROM sents p JOIN sfold f ON p.document_id = f.document_id AND p.page_number = f.page_number AND p.run = f.run AND p.g = f.g AND p.i = f.i),
middle AS (SELECT document_id, page_number, run, any_value(path) AS path, g, sg, 0 AS piece, string_agg(text, ' ' ORDER BY i) AS text FROM sgroups WHERE NOT large GROUP BY document_id, page_number, run, g, sg),
wlist AS (SELECT document_id, page_number, run, path, g, sg, regexp_extract_all(text, '\\S+') AS w FROM sgroups WHERE large),
wide AS (SELECT document_id, page_number, run, path, g, sg, unnest(range(0, len(w), {pmax})) AS piece, """
    + _WINDOWS.replace("{w}", "w").replace("{m}", "{pmax}")
    + """ AS text FROM wlist),
alist AS (SELECT document_id, page_number, run, path, block_type, text, regexp_extract_all(text, '\\S+') AS w FROM runs WHERE is_atomic),
atoms AS (SELECT document_id, page_number, run, path, block_type, 0 AS piece, text, true AS whole FROM alist WHERE len(w) <= {pmax}
  UNION ALL SELECT document_id, page_number, run, path, block_type, unnest(range(0, len(w), {pmax})) AS piece, """
    + _WINDOWS.replace("{w}", "w").replace("{m}", "{pmax}")
    + """ AS text, false FROM alist WHERE len(w) > {pmax}),
pieces AS (SELECT document_id, page_number, run, path, 'text' AS chunk_type, CAST(NULL AS BOOLEAN) AS atomic, g, sg, piece, text FROM (SELECT * FROM small UNION ALL SELECT * FROM middle UNION ALL SELECT * FROM wide)
  UNION ALL SELECT document_id, page_number, run, path, block_type, whole, 0, 0, piece, text FROM atoms),
sec AS (SELECT sha256(document_id || ':' || page_number || ':' || text) AS chunk_id, document_id, text, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY run, g, sg, piece) - 1 AS chunk_index,
  array_to_string(path, ' > ') AS path, chunk_type, len(regexp_extract_all(text, '\\S+')) AS token_count, atomic FROM pieces)"""
)
_NEAR = """asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM asked, embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored),
hits AS (SELECT r.*, c.text, c.chunk_id AS source FROM ranked r JOIN chunks c ON c.chunk_row = r.vec_id WHERE rank <= 5)"""
_CHUNKS = "lastc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, chunk_row DESC) AS n FROM chunks) WHERE n = 1)"
_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id))"
_POINT = f"""substr({_UUID}, 1, 8) || '-' || substr({_UUID}, 9, 4) || '-5' || substr({_UUID}, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({_UUID}, 17, 1)), 1) || substr({_UUID}, 18, 3) || '-' || substr({_UUID}, 21, 12)"""
_WINDOWED = """w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 800)) AS start_char FROM documents WHERE trim(text, '{ws}') <> '')"""

_RAW = {
    "load_text": "SELECT doc_id, 1::BIGINT AS page_number, length(t)::BIGINT AS characters, sha256(t) AS content_id FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL)",
    "document_id": "SELECT doc_id, sha256(text) AS content_id FROM documents WHERE text IS NOT NULL",
    "fixed_chunks": "WITH " + _WINDOWED + """ SELECT printf('%s_chunk_%04d', doc_id::VARCHAR, start_char // 800) AS chunk_id, doc_id, substring(text, start_char + 1, 1000) AS text, (start_char // 800)::BIGINT AS chunk_index, start_char::BIGINT AS start_char,
  least(start_char + 1000, n)::BIGINT AS end_char, 1000::BIGINT AS chunk_size, 200::BIGINT AS overlap, count(*) OVER (PARTITION BY doc_id)::BIGINT AS total_chunks, 'fixed' AS strategy, 'fixed' AS chunking_strategy FROM w""",
    "fixed_chunk_stats": "WITH " + _WINDOWED + " SELECT doc_id, count(*)::BIGINT AS chunks, count(*)::BIGINT AS total_chunks, max(least(start_char + 1000, n))::BIGINT AS end_char, sum(length(substring(text, start_char + 1, 1000)))::BIGINT AS characters FROM w GROUP BY doc_id",
    "csv_row_render": "SELECT c_custkey, 'c_custkey: ' || c_custkey || ' | c_name: ' || coalesce(c_name, '') || ' | c_nationkey: ' || coalesce(c_nationkey::VARCHAR, '') || ' | c_mktsegment: ' || coalesce(c_mktsegment, '') AS text FROM customer",
    "strip_nonblank": "SELECT block_row, trim(text, '{ws}') AS text FROM blocks WHERE trim(text, '{ws}') <> ''",
    "figure_caption": "WITH " + _TYPED + " SELECT document_id, seq::BIGINT AS seq, text, caption FROM typed WHERE block_type = 'figure'",
    "heading_level": "WITH " + _TYPED + " SELECT document_id, seq::BIGINT AS seq, text, (CASE WHEN regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)\\b', 1) <> '' THEN len(string_split(regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)\\b', 1), '.')) END)::BIGINT AS number_level, heading_level::BIGINT AS level FROM levelled WHERE block_type = 'heading'",
    "block_extract": "WITH " + _TYPED + " SELECT document_id, page_number::BIGINT AS page_number, block_order::BIGINT AS block_order, block_type, text, block_type IN ('table', 'figure', 'formula', 'code') AS atomic FROM blk",
    "section_ids": "WITH " + _TYPED + " SELECT document_id, block_order::BIGINT AS block_order, (CASE WHEN block_type <> 'title' THEN nullif(h, 0) END)::BIGINT AS section_id, heading_level::BIGINT AS heading_level FROM blk",
    "section_paths": "WITH " + _PATHS + " SELECT document_id, block_order::BIGINT AS block_order, array_to_string(path, ' > ') AS path, len(path)::BIGINT AS depth FROM pathed",
    "section_paths_v1": "WITH RECURSIVE " + _LATEST + """, vh AS (SELECT document_id, seq, coalesce(text, '') AS text, greatest(coalesce(item_level, 1), 1) AS lev, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS i FROM items WHERE page_no IS NOT NULL AND kind IN ('title', 'heading')),
f AS (SELECT document_id, seq, i, [text] AS path FROM vh WHERE i = 1 UNION ALL SELECT h.document_id, h.seq, h.i, list_append(f.path[1 : h.lev - 1], h.text) FROM f JOIN vh h ON h.document_id = f.document_id AND h.i = f.i + 1)
SELECT document_id, seq::BIGINT AS seq, array_to_string(path, ' > ') AS path FROM f""",
    "block_type_counts": "WITH " + _TYPED + " SELECT document_id, string_agg(block_type || '=' || n, ',' ORDER BY block_type) AS block_types FROM (SELECT document_id, block_type, count(*) AS n FROM blk GROUP BY ALL) GROUP BY document_id",
    "document_stats": "WITH " + _TYPED + " SELECT document_id, count(DISTINCT page_number)::BIGINT AS page_count, count(*)::BIGINT AS block_count FROM blk GROUP BY document_id",
    "page_groups": "WITH " + _TYPED + " SELECT document_id, page_number::BIGINT AS page_number, count(*)::BIGINT AS blocks, sha256(string_agg(text, chr(10) ORDER BY block_order)) AS text_id FROM blk GROUP BY document_id, page_number",
    "empty_documents": "WITH " + _TYPED + " SELECT document_id, coalesce(error, 'no content was extracted') AS error FROM loaded_documents WHERE document_id NOT IN (SELECT document_id FROM blk)",
    "page_sections": "WITH RECURSIVE " + _TYPED + """, vh AS (SELECT document_id, seq, page_no, coalesce(text, '') AS text, greatest(coalesce(item_level, 1), 1) AS lev, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS i FROM items WHERE page_no IS NOT NULL AND kind IN ('title', 'heading')),
f AS (SELECT document_id, seq, page_no, i, [text] AS path FROM vh WHERE i = 1 UNION ALL SELECT h.document_id, h.seq, h.page_no, h.i, list_append(f.path[1 : h.lev - 1], h.text) FROM f JOIN vh h ON h.document_id = f.document_id AND h.i = f.i + 1),
s AS (SELECT document_id, page_no, string_agg(array_to_string(path, ' > '), ' / ' ORDER BY seq) AS sections FROM f GROUP BY ALL),
g AS (SELECT document_id, page_number AS page_no, string_agg(text, ' / ' ORDER BY seq) AS figures FROM typed WHERE block_type = 'figure' GROUP BY ALL),
p AS (SELECT DISTINCT document_id, page_no FROM items WHERE page_no IS NOT NULL)
SELECT document_id, page_no::BIGINT AS page_number, coalesce(sections, '') AS sections, coalesce(figures, '') AS figures FROM p LEFT JOIN s USING (document_id, page_no) LEFT JOIN g USING (document_id, page_no)""",
    "page_feature_stats": "WITH " + _TYPED + """, p AS (SELECT document_id, page_number, string_agg(text, chr(10) ORDER BY block_order) AS text FROM blk GROUP BY ALL),
v AS (SELECT document_id, page_no AS page_number, count(*) FILTER (kind IN ('title', 'heading')) AS sections, count(*) FILTER (kind = 'figure') AS figures FROM items WHERE page_no IS NOT NULL GROUP BY ALL)
SELECT document_id, count(*)::BIGINT AS pages, sum(length(text))::BIGINT AS characters, sum(figures)::BIGINT AS figures, (count(*) FILTER (sections > 0))::BIGINT AS pages_with_sections,
  (count(*) FILTER (contains(text, '|---|') OR contains(text, '| --- |')))::BIGINT AS pages_with_tables, sum(((length(text) - length(replace(text, '$$', ''))) // 2) // 2)::BIGINT AS formulas FROM p JOIN v USING (document_id, page_number) GROUP BY document_id""",
    "section_runs": "WITH " + _RUNS + " SELECT document_id, page_number::BIGINT AS page_number, run::BIGINT AS run, count(*)::BIGINT AS blocks, min(block_order)::BIGINT AS first_order, array_to_string(any_value(path), ' > ') AS path FROM runs GROUP BY document_id, page_number, run",
    "paragraph_packing": "WITH RECURSIVE " + _PARAGRAPHS.replace("{pmax}", "80") + " SELECT document_id, page_number::BIGINT AS page_number, run::BIGINT AS run, block_order::BIGINT AS block_order, g::BIGINT AS group_no FROM pgroups",
    "sentence_packing": "WITH RECURSIVE " + _TYPED + ", sl AS (SELECT document_id, block_order, " + _SPLIT.replace("{t}", "text") + """ AS s FROM blk WHERE block_type NOT IN ('table', 'figure', 'formula', 'code')),
se AS (SELECT document_id, block_order, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM sl), sk AS (SELECT *, len(regexp_extract_all(sentence, '\\S+')) AS k FROM se),
f AS (SELECT document_id, block_order, i, sentence, 0 AS g, CASE WHEN k > 25 THEN 0 ELSE k END AS used, k > 25 AS large FROM sk WHERE i = 1
  UNION ALL SELECT p.document_id, p.block_order, p.i, p.sentence, CASE WHEN p.k > 25 OR f.large OR f.used + p.k > 25 THEN f.g + 1 ELSE f.g END, CASE WHEN p.k > 25 THEN 0 WHEN f.large OR f.used + p.k > 25 THEN p.k ELSE f.used + p.k END, p.k > 25
  FROM f JOIN sk p ON p.document_id = f.document_id AND p.block_order = f.block_order AND p.i = f.i + 1)
SELECT document_id, block_order::BIGINT AS block_order, (i - 1)::BIGINT AS sentence_no, sentence, g::BIGINT AS group_no FROM f""",
    "hard_token_split": "WITH " + _TYPED + ", x AS (SELECT document_id, block_order, regexp_extract_all(text, '\\S+') AS w FROM blk) SELECT document_id, block_order::BIGINT AS block_order, (unnest(range(0, len(w), 20)) // 20)::BIGINT AS piece_no, " + _WINDOWS.replace("{w}", "w").replace("{m}", "20") + " AS text FROM x",
    "atomic_chunks": "WITH RECURSIVE " + _SECTION.replace("{pmax}", "60") + " SELECT chunk_id, document_id, page_number::BIGINT AS page_number, chunk_type, token_count::BIGINT AS token_count, atomic FROM sec WHERE atomic IS NOT NULL",
    "section_chunks": "WITH RECURSIVE " + _SECTION.replace("{pmax}", "60") + " SELECT chunk_id, document_id, text, page_number::BIGINT AS page_number, chunk_index::BIGINT AS chunk_index, path, chunk_type, token_count::BIGINT AS token_count, atomic FROM sec",
    "chunk_index": "WITH RECURSIVE " + _SECTION.replace("{pmax}", "60") + " SELECT document_id, page_number::BIGINT AS page_number, count(*)::BIGINT AS chunks, true AS contiguous FROM sec GROUP BY document_id, page_number",
    "chunk_preview": "SELECT chunk_row, replace(substring(text, 1, 250), chr(10), ' ') AS preview FROM chunks",
    "breadcrumb": "SELECT chunk_row, coalesce(array_to_string(section_path, ' > '), '') AS path FROM chunks",
    "chunk_ids": "SELECT chunk_row, sha256(document_id || ':' || page_number || ':' || text) AS key FROM chunks WHERE page_number IS NOT NULL AND text IS NOT NULL",
    "point_ids": f"SELECT chunk_row, {_POINT} AS point_id FROM chunks WHERE chunk_id IS NOT NULL",
    "chunk_stats": "WITH " + _CHUNKS + " SELECT document_id, count(*)::BIGINT AS chunks, max(token_count)::BIGINT AS max_tokens, sum(token_count)::BIGINT AS tokens, (count(*) FILTER (coalesce(atomic, false)))::BIGINT AS atomic_chunks FROM lastc GROUP BY document_id",
    "oversized_chunks": "SELECT chunk_row, token_count::BIGINT AS token_count FROM chunks WHERE token_count > 150",
    "metadata_contract": """WITH m AS (SELECT chunk_row, list_filter([CASE WHEN chunk_index IS NULL THEN 'chunk_index' END, CASE WHEN document_name IS NULL THEN 'document_name' END, CASE WHEN mime_type IS NULL THEN 'mime_type' END,
  CASE WHEN page_number IS NULL THEN 'page_number' END, CASE WHEN source_path IS NULL THEN 'source_path' END, CASE WHEN strategy IS NULL THEN 'strategy' END], lambda x: x IS NOT NULL) AS missing, coalesce(chunk_id, '') = '' AS empty_id
  FROM chunks LEFT JOIN loaded_documents USING (document_id)) SELECT chunk_row, array_to_string(missing, ',') AS missing, empty_id FROM m WHERE len(missing) > 0 OR empty_id""",
    "sectionless_chunks": "SELECT chunk_row, chunk_type FROM chunks WHERE section_path IS NULL OR len(section_path) = 0",
    "atomic_filter": "SELECT chunk_row, chunk_type FROM chunks WHERE atomic",
    "page_index_check": "WITH " + _CHUNKS + " SELECT document_id, page_number::BIGINT AS page_number, strategy, count(*)::BIGINT AS chunks, list_sort(list(chunk_index)) = range(0, count(*)) AS contiguous FROM lastc WHERE page_number IS NOT NULL GROUP BY document_id, page_number, strategy",
    "vector_validation": "SELECT label::BIGINT AS label, count(*)::BIGINT AS vectors, (count(*) FILTER (len(embedding) IS DISTINCT FROM 64))::BIGINT AS wrong, bool_and(len(embedding) = 64) AS all_fit FROM embeddings GROUP BY label",
    "cosine_scores": "WITH " + _NEAR + " SELECT query_id, vec_id, round(score, 6) AS score FROM scored",
    "topk_multi": "WITH " + _NEAR + " SELECT query_id, vec_id, rank::BIGINT AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "topk_search": """WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 0), m AS (SELECT list(a ORDER BY i) AS q FROM (SELECT i, avg(x) AS a FROM x GROUP BY i)),
s AS (SELECT vec_id, label, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM embeddings, m) SELECT vec_id, label::BIGINT AS label, row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank, round(score, 6) AS score FROM s ORDER BY rank LIMIT 5""",
    "chunk_vector_join": "SELECT chunk_row, document_id, len(embedding)::BIGINT AS dimension, label::BIGINT AS label FROM chunks JOIN embeddings ON vec_id = chunk_row",
    "vector_pairing": "SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM chunks WHERE chunk_row NOT IN (SELECT vec_id FROM embeddings)) AS without_vector, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT chunk_row FROM chunks)) AS without_chunk",
    "chunk_contract": "WITH RECURSIVE " + _SECTION.replace("{pmax}", "60") + """ SELECT chunk_id, page_number::BIGINT AS page_number, chunk_index::BIGINT AS chunk_index,
  concat_ws(',', CASE WHEN document_name IS NULL THEN 'document_name' END, CASE WHEN mime_type IS NULL THEN 'mime_type' END, CASE WHEN source_path IS NULL THEN 'source_path' END) AS missing, false AS empty_id
  FROM sec LEFT JOIN loaded_documents USING (document_id) WHERE document_name IS NULL OR mime_type IS NULL OR source_path IS NULL""",
    "pipeline_points": "WITH RECURSIVE " + _SECTION.replace("{pmax}", "60") + f""", once AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_index) AS n FROM sec)
SELECT {_POINT} AS point_id, 64::BIGINT AS dimension, sha256(text) AS text_id, array_to_string(list_filter(['atomic=' || atomic, 'chunk_id=' || chunk_id, 'chunk_index=' || chunk_index, 'chunk_type=' || chunk_type, 'document_id=' || document_id,
  'document_name=' || document_name, 'mime_type=' || mime_type, 'page_number=' || page_number, 'section_path=' || path, 'source_path=' || source_path, 'strategy=section_aware', 'token_count=' || token_count], lambda x: x IS NOT NULL), ',') AS payload
FROM once LEFT JOIN loaded_documents USING (document_id) WHERE n = 1""",
    "hash_embed": """WITH bits AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i::UBIGINT, list_transform(range(0, 8), lambda z: 0::UBIGINT)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
listed AS (SELECT chunk_row, string_split(trim(regexp_replace(translate(lower(text), '{ws}', repeat(' ', 29)), ' +', ' ', 'g')), ' ') AS w FROM chunks WHERE text IS NOT NULL),
words AS (SELECT chunk_row, unnest(w) AS w FROM listed),
coded AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words WHERE w <> '')),
octets AS (SELECT w, list_transform(range(0, len(h) // 2), lambda i: ((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::UBIGINT) AS b FROM coded),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM octets, bits),
marks AS (SELECT chunk_row, ((h >> 1) % 64)::INT AS d, sum(CASE WHEN h & 1 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM words JOIN crc USING (w) GROUP BY ALL),
norms AS (SELECT chunk_row, sqrt(sum(v * v)) AS n, map_from_entries(list((d, v))) AS m FROM marks GROUP BY chunk_row)
SELECT chunk_row, list_transform(range(0, 64), lambda d: (CASE WHEN n > 0 THEN coalesce(m[d::INT], 0) / n ELSE 0 END)::FLOAT) AS vector FROM listed LEFT JOIN norms USING (chunk_row)""",
    "upsert_merge": "SELECT chunk_id, chunk_row, document_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' DESC, loaded_at DESC, chunk_row DESC) AS n FROM chunks) WHERE n = 1",
    "point_payload": "SELECT chunk_row, array_to_string(list_filter(['chunk_id=' || chunk_id, 'chunk_index=' || chunk_index, 'document_id=' || document_id, 'page_number=' || page_number, 'strategy=' || upper(strategy)], lambda x: x IS NOT NULL), ',') AS payload FROM (SELECT chunk_row, chunk_id, chunk_index::VARCHAR AS chunk_index, document_id, page_number::VARCHAR AS page_number, strategy FROM chunks)",
    "point_lookup": f"WITH p AS (SELECT *, {_POINT} AS point_id FROM chunks) SELECT point_id, chunk_row, deliveries FROM (SELECT point_id, chunk_row, row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC, chunk_row DESC) AS n, count(*) OVER (PARTITION BY point_id)::BIGINT AS deliveries FROM p) WHERE n = 1 AND deliveries > 1",
    "collection_stats": "WITH " + _CHUNKS + " SELECT document_id, count(*)::BIGINT AS points, count(DISTINCT strategy)::BIGINT AS strategies FROM lastc GROUP BY document_id",
    "citations": "WITH " + _NEAR + ", n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM hits) SELECT query_id, position::BIGINT AS position, printf('[%d] %s (similarity: %.4f)', position, source, score) AS citation FROM n",
    "answer_context": "WITH " + _NEAR + " SELECT query_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS context_id, string_agg(source, ',' ORDER BY rank) AS sources FROM hits GROUP BY query_id",
}

SQL = {name: sql.replace("{ws}", WHITE_SPACE) for name, sql in _RAW.items()}
