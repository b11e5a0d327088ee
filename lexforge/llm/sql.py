"""SQL over whole tables for the queries that it can express."""

from __future__ import annotations

from lexforge.functions.text import BLANKS, width_pairs

_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||" + "||".join(f"chr({ord(c)})" for c in BLANKS if ord(c) > 126)
_FROM, _TO = (x.replace("'", "''") for x in width_pairs())

_P2 = f"""WITH books AS (SELECT DISTINCT textbook_id FROM textbooks WHERE NOT lower(filename) LIKE '%pdf'),
ch AS (SELECT DISTINCT textbook_id, ord, content FROM chapters SEMI JOIN books USING (textbook_id)),
total AS (SELECT textbook_id, count(DISTINCT ord) AS n FROM ch GROUP BY 1),
parts AS (SELECT textbook_id, ord, string_split(content, chr(10)) AS a FROM ch),
lines AS (SELECT textbook_id, ord, i - 1 AS line_no, regexp_replace(lower(translate(a[i], '{_FROM}', '{_TO}')), '[^\\p{{L}}]', '', 'g') AS w
  FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM parts)),
freq AS (SELECT textbook_id, w, count(DISTINCT ord) AS n FROM lines WHERE w <> '' GROUP BY 1, 2),
found AS (SELECT DISTINCT l.textbook_id, l.ord, CAST(l.line_no AS INTEGER) AS line_no FROM lines l JOIN freq f USING (textbook_id, w) JOIN total t USING (textbook_id) WHERE f.n * 4 >= t.n)"""

SQL = {
    "p2_found": f"{_P2} SELECT * FROM found",
    "p2_cleaned": f"""{_P2}, once AS (SELECT textbook_id, ord, max(content) AS content FROM ch WHERE textbook_id IS NOT NULL GROUP BY 1, 2),
split AS (SELECT textbook_id, ord, i - 1 AS line_no, a[i] AS line FROM (SELECT textbook_id, ord, string_split(content, chr(10)) AS a, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM once)),
kept AS (SELECT textbook_id, ord, string_agg(line, chr(10) ORDER BY line_no) AS content FROM split ANTI JOIN found USING (textbook_id, ord, line_no) GROUP BY 1, 2)
SELECT o.textbook_id, o.ord, CASE WHEN o.content IS NULL THEN NULL ELSE coalesce(k.content, '') END AS content FROM once o LEFT JOIN kept k USING (textbook_id, ord)""",
    "p5_found": f"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, list_append(coalesce(affected_nodes, []), result_node) AS ids FROM decisions WHERE lower(trim(action, {_WS})) = 'merge'),
e AS (SELECT DISTINCT r, nullif(lower(trim(id, {_WS})), '') AS id FROM (SELECT r, unnest(ids) AS id FROM m) WHERE nullif(trim(id, {_WS}), '') IS NOT NULL),
l AS (SELECT DISTINCT x.id AS a, y.id AS b FROM e x JOIN e y USING (r) WHERE x.id <> y.id),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT least(a, min(b)) AS group_id, a AS node_id FROM reach GROUP BY a""",
    "p7_links": f"""WITH n AS (SELECT lower(trim(id, {_WS})) AS id, CAST(min(embedding) AS DOUBLE[64]) AS e FROM nodes
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND nullif(trim(id, {_WS}), '') IS NOT NULL GROUP BY 1)
SELECT a.id, min(CASE WHEN a.e = b.e THEN b.id END) AS class_id, count(*) - 1 AS n_links FROM n a JOIN n b ON array_cosine_similarity(a.e, b.e) >= 0.90 GROUP BY a.id""",
    "p7_found": f"""WITH v AS (SELECT DISTINCT ON (id) lower(trim(id, {_WS})) AS id, CAST(embedding AS DOUBLE[64]) AS e FROM nodes
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.id < b.id AND array_cosine_similarity(a.e, b.e) >= 0.90""",
}
