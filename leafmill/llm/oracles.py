"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from leafmill.functions.text import WHITE_SPACE

_SIMILAR = """norm AS (SELECT chunk_row, trim(regexp_replace(translate(lower(text), '{ws}', repeat(' ', 29)), ' +', ' ', 'g')) AS t FROM chunks WHERE text IS NOT NULL AND chunk_row IS NOT NULL),
texts AS (SELECT t, row_number() OVER (ORDER BY t) AS id FROM (SELECT DISTINCT t FROM norm WHERE length(t) >= 100)),
grams AS (SELECT DISTINCT id, substring(t, unnest(range(1, length(t) - 3)), 5) AS g FROM texts),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
near AS (SELECT a, b FROM common JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE c >= 0.7 * (x.n + y.n - c)),
members AS (SELECT chunk_row, id FROM norm JOIN texts USING (t))""".replace("{ws}", WHITE_SPACE)

SQL = {
    "p5_found": "WITH " + _SIMILAR + """,
pairs AS (SELECT p.chunk_row AS r, q.chunk_row AS s FROM near JOIN members p ON p.id = a JOIN members q ON q.id = b
  UNION ALL SELECT p.chunk_row, q.chunk_row FROM members p JOIN members q ON p.id = q.id AND p.chunk_row < q.chunk_row)
SELECT least(r, s) AS row_a, greatest(r, s) AS row_b FROM pairs""",
    "p5_groups": "WITH RECURSIVE " + _SIMILAR + """,
edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT id AS x, id AS y FROM texts UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
firsts AS (SELECT x AS id, min(chunk_row) AS group_id FROM reach JOIN members m ON m.id = y GROUP BY x),
degrees AS (SELECT a AS id, count(*) AS links FROM edges GROUP BY a)
SELECT chunk_row, group_id, coalesce(links, 0)::BIGINT AS links FROM members JOIN firsts USING (id) LEFT JOIN degrees USING (id)""",
    # what must hold of every packing and of every mixture
    "p2_cover": """SELECT b.document_id, count(*)::BIGINT AS blocks, 0::BIGINT AS cut_in_vain, 0::BIGINT AS over FROM blocks b
WHERE lower(replace(replace(trim(block_type, '{ws}'), '-', '_'), ' ', '_')) IN ('text', 'list_item') AND trim(text, '{ws}') <> '' AND document_id NOT IN (SELECT document_id FROM loaded_documents WHERE loader = 'scan') GROUP BY b.document_id""".replace("{ws}", WHITE_SPACE),
    "p7_repeats": "SELECT source, 0::BIGINT AS too_often, 0::BIGINT AS twice FROM mix_targets",
}
