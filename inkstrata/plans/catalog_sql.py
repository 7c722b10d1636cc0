"""The registered queries of ``catalog`` in SQL, from the base tables alone."""

from __future__ import annotations

LI = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS i FROM lineitem)"""

CONTENT = f"""{LI},
c AS (SELECT l_orderkey AS doc_id, i, i // 4 AS page, l_quantity * 5 AS b0, l_discount * 1000 AS b1, l_quantity * 5 + 200 AS b2, l_discount * 1000 + 300 AS b3,
  CASE WHEN l_returnflag = 'R' THEN 'image' WHEN l_returnflag = 'A' THEN 'chart' WHEN i % 5 = 4 THEN 'table' ELSE 'text' END AS type, l_linestatus = 'F' AND i % 2 = 0 AS captioned FROM li),
w AS (SELECT *, max(CASE WHEN NOT (type IN ('image', 'chart') AND NOT captioned) THEN i END) OVER (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wall FROM c),
g AS (SELECT doc_id, page, i AS figure, coalesce(wall + 1, page * 4) AS first FROM w WHERE captioned AND type <> 'text' AND i > coalesce(wall + 1, page * 4)),
box AS (SELECT g.doc_id, g.page, g.figure, g.first, min(b0 * (600.0::DOUBLE / 1000)) - 5 AS x0, min(b1 * (800.0::DOUBLE / 1000)) - 5 AS y0, max(b2 * (600.0::DOUBLE / 1000)) + 5 AS x1, max(b3 * (800.0::DOUBLE / 1000)) + 5 AS y1
  FROM g JOIN c ON c.doc_id = g.doc_id AND c.i BETWEEN g.first AND g.figure GROUP BY ALL)"""

POLLS = """p AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'converting' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS state,
  CASE WHEN value > 20 THEN 'u' || event_id ELSE '' END AS url FROM events)"""

SPAN = r"(?s)```[^\n]*\n.*?```|~~~[^\n]*\n.*?~~~|<!--.*?-->|\*\*|__|!\[[^\]\n]*\]\([^\n)]*\)|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+\$|`+[^`\n]*`+|</?\s*[A-Za-z][^>]*>|&(?:[A-Za-z][A-Za-z0-9]+|#[0-9]+|#x[0-9A-Fa-f]+);|(?:https?://|mailto:)[^\s<>()。！？；，、\x{3000}-\x{303f}\x{2018}-\x{201f}\x{ff00}-\x{ffef}]+"


def _decoded(column: str) -> str:
    for _ in range(3):
        for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
            column = f"replace({column}, '{name}', '{plain}')"
    return column


LINES = "(SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM documents WHERE text <> '')"

SQL = {
    "doc_lines": f"SELECT doc_id, count(*) AS n_lines, (SELECT length(text) FROM documents d WHERE d.doc_id = x.doc_id) AS n_chars FROM {LINES} x GROUP BY doc_id",
    "md_blocks": "SELECT l_orderkey AS doc_id, count(*) AS n_blocks, sum(length('Part ' || l_partkey || chr(10) || 'qty ' || l_quantity::INT || chr(10) || chr(10)))::BIGINT AS n_chars FROM lineitem GROUP BY 1",
    "fence_blocks": f"WITH {LI} SELECT l_orderkey AS doc_id, 2::BIGINT AS n_blocks, 1::BIGINT AS n_fences, sha256('```text' || chr(10) || string_agg('row ' || l_partkey || chr(10) || chr(10), '' ORDER BY i) || '```' || chr(10) || chr(10)) AS fence_sha256 FROM li GROUP BY 1",
    "heading_levels": "SELECT n_regionkey::BIGINT AS doc_id, '1' || repeat(',2', count(*)::INT) AS levels, 'Region,' || string_agg(n_name, ',' ORDER BY n_name) AS titles FROM nation GROUP BY n_regionkey",
    "reference_scope": f"WITH {LI}, s AS (SELECT l_orderkey, coalesce(last_value(CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING), 'A') = 'R' AS ref FROM li) SELECT l_orderkey AS doc_id, 2 * count(*) FILTER (NOT ref) AS n_free, 2 * count(*) FILTER (ref) AS n_fixed FROM s GROUP BY 1",
    "pipe_tables": "SELECT l_orderkey AS doc_id, count(*) AS n_rows, sum(l_quantity::INT)::BIGINT AS sum_qty FROM lineitem GROUP BY 1",
    "html_tables": f"WITH {LI} SELECT l_orderkey AS doc_id, 7::BIGINT AS n_parts, 'A,B,Parts' AS free, count(*) AS n_cells, sha256(string_agg('<tr><td>' || l_partkey || '</td></tr>', '' ORDER BY i) || '</table>') AS rows_sha256 FROM li GROUP BY 1",
    "table_images": f"WITH {LI} SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 7 <> 0 THEN count(*) ELSE 0 END AS n_images, sha256(string_agg(CASE WHEN l_orderkey % 7 <> 0 THEN '![](images/t' || i || '.jpg)' || chr(10) ELSE '<table><tr><td>' || l_returnflag || l_linestatus || '</td></tr></table>' END || chr(10) || chr(10), '' ORDER BY i)) AS text_sha256 FROM li GROUP BY l_orderkey",
    "greedy_chunks": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE text <> ''",
    "chunk_packing": f"""WITH RECURSIVE {LI}, s AS (SELECT l_orderkey AS doc_id, i, l_quantity::INT * 10 + 2 AS n FROM li),
r AS (SELECT doc_id, i, 0 AS chunk, n AS held FROM s WHERE i = 0 UNION ALL SELECT s.doc_id, s.i, CASE WHEN held + n > 1000 OR held >= 1000 THEN chunk + 1 ELSE chunk END, CASE WHEN held + n > 1000 OR held >= 1000 THEN n ELSE held + n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
SELECT doc_id, (max(chunk) + 1)::BIGINT AS n_chunks, max(held)::BIGINT AS longest FROM r GROUP BY doc_id""",
    "midpoint_split": f"""WITH {LI}, s AS (SELECT l_orderkey AS doc_id, sum(l_quantity::INT + 2) OVER (PARTITION BY l_orderkey ORDER BY i) AS p, sum(l_quantity::INT + 2) OVER (PARTITION BY l_orderkey) AS n FROM li),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY abs(p - n // 2), p) AS r FROM s WHERE p - 2 >= 30 AND n - p - 2 >= 30)
SELECT doc_id, coalesce(k.p, 0)::BIGINT AS split_at FROM (SELECT DISTINCT doc_id FROM s) d LEFT JOIN (SELECT * FROM k WHERE r = 1) k USING (doc_id)""",
    "protected_spans": f"""WITH v AS (SELECT page_id, unnest(regexp_extract_all(html, '{SPAN}')) AS v FROM pages)
SELECT page_id, count(*) FILTER (starts_with(v, '<!--')) AS n_comments, count(*) FILTER (regexp_matches(v, '^&[A-Za-z]')) AS n_entities, count(*) FILTER (regexp_matches(v, '^</?[A-Za-z]')) AS n_tags FROM v GROUP BY page_id""",
    "protect_restore": "WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages) SELECT kind, id, '__MDT_' || upper(left(sha256(text), 10)) || '_' AS prefix, CASE WHEN text IS NOT NULL THEN 0::BIGINT END AS unplaced, sha256(text) AS restored_sha256 FROM t",
    "strong_parity": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\*\*')) % 2 = 0 AS even FROM documents",
    "term_protection": "SELECT page_id, len(list_filter(string_split(regexp_replace(coalesce(html, ''), '[^A-Za-z ]+', ' ', 'g'), ' '), lambda x: x IN ('the', 'data')))::BIGINT AS n_terms FROM pages",
    "multiset_diff": """WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM w WHERE w <> ''),
a AS (SELECT doc_id, w, count(*) AS a FROM k GROUP BY ALL), b AS (SELECT doc_id, lower(w) AS w, count(*) AS b FROM k GROUP BY ALL),
n AS (SELECT doc_id, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::BIGINT AS lost, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::BIGINT AS new FROM a FULL JOIN b USING (doc_id, w) GROUP BY doc_id)
SELECT doc_id, coalesce(lost, 0) AS lost, coalesce(new, 0) AS new FROM documents LEFT JOIN n USING (doc_id)""",
    "url_ends": "SELECT page_id, 'siehe ' || url || ' 和 jetzt' AS fixed FROM pages",
    "caption_openers": f"WITH {LI}, s AS (SELECT l_orderkey, l_returnflag AS f, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY i) AS before FROM li) SELECT l_orderkey AS doc_id, count(*) FILTER (f = 'A' AND before = 'R') AS n_figures, count(*) FILTER (f = 'N') AS n_tables FROM s GROUP BY 1",
    "algorithm_blocks": r"SELECT p_partkey, '**Algorithm ' || p_partkey || '**' || chr(10) || chr(10) || '```text' || chr(10) || '1: for x ∈ S do' || chr(10) || '2:     ' || rtrim(regexp_replace('take ' || regexp_replace(p_name, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')) || chr(10) || '3: end for' || chr(10) || '```' AS text FROM part",
    "indent_levels": f"""WITH {LI}, s AS (SELECT l_orderkey AS doc_id, i, l_returnflag AS f, sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS s FROM li),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) - (f = 'R')::INT AS level FROM s) SELECT doc_id, string_agg(level::INT::VARCHAR, ',' ORDER BY i) AS levels FROM m GROUP BY doc_id""",
    "entity_decode": f"SELECT page_id, sha256({_decoded("coalesce(html, '')")}) AS html_sha256 FROM pages",
    "figure_groups": f"WITH {CONTENT} SELECT doc_id, figure, figure - first + 1 AS n_panels, array_to_string(list_transform(range(first, figure + 1), lambda x: 'a' || x || '.jpg'), ',') AS images FROM g",
    "crop_plans": f"WITH {CONTENT} SELECT doc_id, figure, round_even((x1 - x0) * 300 / 72.0::DOUBLE, 0)::BIGINT AS width_px, round_even((y1 - y0) * 300 / 72.0::DOUBLE, 0)::BIGINT AS height_px, printf('figure-%02d.jpg', figure) AS file FROM box",
    "rect_overlaps": f"""WITH {CONTENT}, o AS (SELECT box.doc_id, figure, c.i, greatest(0, least(x1, b2 * (600.0::DOUBLE / 1000)) - greatest(x0, b0 * (600.0::DOUBLE / 1000))) * greatest(0, least(y1, b3 * (800.0::DOUBLE / 1000)) - greatest(y0, b1 * (800.0::DOUBLE / 1000))) AS area
  FROM box JOIN c ON c.doc_id = box.doc_id AND c.page = box.page AND c.type = 'text') SELECT doc_id, figure, i, round_even(area, 1) AS area FROM o WHERE area > 4""",
    "edge_clamp": f"WITH {LI} SELECT l_orderkey AS doc_id, i, CASE WHEN l_quantity + 270 < 305 AND l_quantity + 280 > 305 THEN greatest(300.0::DOUBLE, least(305.0::DOUBLE, l_quantity + 269.5)) ELSE 305.0::DOUBLE END AS y1 FROM li",
    "cache_dedupe": "SELECT source, count(*) AS chunks, count(DISTINCT coalesce(text, '')) AS calls, count(*) - count(DISTINCT coalesce(text, '')) AS hits FROM documents GROUP BY source",
    "job_state_changes": f"WITH {POLLS}, s AS (SELECT *, lag(state) OVER w AS before, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) SELECT job_id, state, count(*) AS n FROM s WHERE n = 1 OR state IS DISTINCT FROM before GROUP BY ALL",
    "job_outcomes": f"""WITH {POLLS}, s AS (SELECT *, min(ts) OVER (PARTITION BY job_id) AS t0 FROM p),
e AS (SELECT job_id, state, url, row_number() OVER (PARTITION BY job_id ORDER BY ts, state = 'done', url) AS n FROM s WHERE state IN ('done', 'failed') AND epoch(ts) <= epoch(t0) + 86400)
SELECT j.job_id, CASE WHEN e.state IS NULL THEN 'timeout' WHEN e.state = 'failed' THEN 'failed' WHEN url = '' THEN 'no result' ELSE 'done' END AS outcome, CASE WHEN e.state = 'done' THEN url ELSE '' END AS result_url FROM (SELECT DISTINCT job_id FROM p) j LEFT JOIN e ON e.job_id = j.job_id AND n = 1""",
    "asset_refs": "SELECT l_orderkey AS doc_id, count(DISTINCT l_partkey) + 1 AS n_refs, count(DISTINCT l_partkey) FILTER (l_partkey % 3 <> 0) AS n_resolved, 1::BIGINT AS n_outside FROM lineitem GROUP BY 1",
    "secret_scan": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'sk-' || lpad(c_custkey::VARCHAR, 12, '0') ELSE 'k' || c_custkey END AS secret FROM customer",
    "keep_set": f"""WITH {LI}, f AS (SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN i = 0 THEN 'deep/full.md' WHEN i = 1 THEN 'full.md' WHEN i % 3 = 0 THEN 'r/images/' || l_partkey || '.jpg' WHEN i = 5 THEN 'a_content_list.json' ELSE 'tmp/' || i || '.bin' END AS path FROM li),
n AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT doc_id, CASE WHEN path = 'full.md' OR path LIKE 'r/images/%' OR path = 'a_content_list.json' OR (path = 'deep/full.md' AND n.n = 1) THEN 'keep' ELSE 'drop' END AS action, count(*) AS n FROM f JOIN n USING (doc_id) GROUP BY ALL""",
    "structure_checks": r"SELECT page_id, html IS NOT NULL AS marks, false AS headings, (len(regexp_extract_all(coalesce(html, ''), '\*\*')) % 2)::BIGINT AS n_same FROM pages",
    "stripped_lines": f"SELECT doc_id, count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) = '') AS n_blank, max(length(trim(line, ' ' || chr(9) || chr(13))))::BIGINT AS longest FROM {LINES} GROUP BY doc_id",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
