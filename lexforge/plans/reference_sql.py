"""SQL of the engine's own queries, over whole tables."""

from __future__ import annotations

import re

from lexforge.functions.text import BLANKS, cn_numbers
from lexforge.operators.chunks import BATCHES, BOUNDARIES, PAGES, RETRIEVAL, Rule
from lexforge.plans.reference import MARKED, OCR_LINES, PAGE_LINES, STOPPED, SUMMARIES, TOTAL_PAGES

_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||" + "||".join(f"chr({ord(c)})" for c in BLANKS if ord(c) > 126)


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


_NODES = "nodes_once AS (SELECT DISTINCT id, name, definition, importance_level, textbook_id, chapter, page, embedding, ord FROM nodes)"
_EDGES = "edges_once AS (SELECT DISTINCT textbook_id, batch_no, source, target, relation_type, description, ord FROM edges)"
_CHAPTERS = "chapters_once AS (SELECT DISTINCT * FROM chapters)"
_BOOKS = "books_once AS (SELECT DISTINCT * FROM textbooks)"
_UNIT = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_V = "CAST(embedding AS DOUBLE[64])"


def _rfind(text: str, what: str, lo: str, hi: str) -> str:
    """Last place of a string in text[lo, hi) counted from 0, or -1."""
    part = f"substr({text}, {lo} + 1, {hi} - ({lo}))"
    return f"CASE WHEN instr(reverse({part}), reverse({what})) > 0 THEN {lo} + length({part}) - instr(reverse({part}), reverse({what})) + 1 - length({what}) ELSE -1 END"


def windows_sql(rule: Rule, source: str, keys: str, text: str) -> str:
    """Recursive windows of every text: keys, a (start), e (end), n (number)."""
    look = f"a + {int(rule.size * rule.look_from)}"
    limit = f"a + {rule.beyond}" if rule.beyond is not None else look
    cases = []
    for b in BOUNDARIES:
        lit = "||".join("chr(10)" if c == "\n" else f"'{c}'" for c in b)
        at = f"({_rfind('t', lit, look, f'a + {rule.size}')})"
        cases.append(f"WHEN {at} > {limit} THEN {at} + 1")
    end = f"CASE WHEN a + {rule.size} >= length(t) THEN length(t) {' '.join(cases)} ELSE a + {rule.size} END"
    short = f"length(t) <= {rule.size}" if rule.whole_if_short else "false"
    return f"""src AS (SELECT {keys}, {text} AS t FROM {source} WHERE length({text}) > 0),
step AS (SELECT {keys}, t, 0 AS a, 0 AS n FROM src UNION ALL
  SELECT {keys}, t, e - {rule.overlap}, n + 1 FROM (SELECT *, {end} AS e FROM step) WHERE e < length(t)),
win AS (SELECT {keys}, t, a, n, {end} AS e FROM step),
cut AS (SELECT {keys}, a, n, length(t) AS len, CASE WHEN {short} AND {str(not rule.strip_short).lower()} THEN t ELSE {_strip("substr(t, a + 1, e - a)")} END AS chunk, {short} AS short FROM win),
kept AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n) - 1 AS chunk_no, count(*) OVER (PARTITION BY {keys}) AS n_chunks FROM cut WHERE (short AND {str(not rule.strip_short).lower()}) OR length(chunk) >= {rule.least})"""


def _chunks(rule: Rule) -> str:
    return f"""WITH RECURSIVE {windows_sql(rule, "documents", "doc_id", "text")}
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(a AS INTEGER) AS char_offset, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS digest FROM kept"""


_TOP = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, c.vec_id AS ord, c.label AS key, array_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON true WHERE {where}),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) <= 10),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY score DESC, ord) = 1)
SELECT {cols} ord, key, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS INTEGER) AS place FROM f QUALIFY place <= 5"""

_PAIRS = f"""{_NODES},
v AS (SELECT id, textbook_id, ord, {_V} AS e, coalesce(length(definition), 0) AS n FROM nodes_once WHERE {_UNIT}),
pairs AS (SELECT a.id AS a, b.id AS b, a.ord AS ao, b.ord AS bo, a.n AS an, b.n AS bn, array_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.ord < b.ord AND a.textbook_id <> b.textbook_id AND array_cosine_similarity(a.e, b.e) >= 0.70)"""
_DECIDED = f"""{_PAIRS},
dec AS (SELECT row_number() OVER (ORDER BY ao, bo) AS no, a, b, s, CASE WHEN s >= 0.95 THEN 'merge' ELSE 'keep' END AS action,
  CASE WHEN s >= 0.95 THEN CASE WHEN an >= bn THEN a ELSE b END END AS res FROM pairs),
touch AS (SELECT no, action, res, unnest([a, b]) AS id FROM dec),
result AS (SELECT DISTINCT id FROM touch WHERE action = 'merge' AND id = res)"""
_OBSERVED = f"{_DECIDED}, kept AS (SELECT * FROM nodes_once WHERE id NOT IN (SELECT id FROM touch) OR id IN (SELECT id FROM result))"
_INTENT = f"{_DECIDED}, kept AS (SELECT * FROM nodes_once WHERE id NOT IN (SELECT id FROM touch WHERE action = 'merge' AND id <> res) OR id IN (SELECT id FROM result))"
_TRIM = """,
base AS (SELECT greatest(sum(length(definition)), 1) AS n FROM nodes_once),
p1 AS (SELECT *, importance_level = '关键' AS crit FROM kept WHERE importance_level IN ('关键', '重要')),
over1 AS (SELECT sum(coalesce(length(definition), 0)) * 1.0 / (SELECT n FROM base) > 0.3 AS o FROM p1),
p2 AS (SELECT * REPLACE (CASE WHEN (SELECT o FROM over1) AND NOT crit AND length(definition) > 100 THEN substr(definition, 1, 97) || '...' ELSE definition END AS definition) FROM p1),
tot AS (SELECT sum(coalesce(length(definition), 0)) AS n FROM p2),
p3 AS (SELECT *, coalesce(sum(CASE WHEN crit THEN 0 ELSE coalesce(length(definition), 0) END) OVER (ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p2),
final AS (SELECT * FROM p3 WHERE crit OR ((SELECT n FROM tot) - before) * 1.0 / (SELECT n FROM base) <= 0.3),
extra AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, id, name FROM kept WHERE coalesce(importance_level NOT IN ('关键', '重要'), true)),
victims AS (SELECT row_number() OVER (ORDER BY id DESC) - 1 AS k, id, name FROM p3 WHERE NOT crit AND ((SELECT n FROM tot) - before) * 1.0 / (SELECT n FROM base) > 0.3),
few AS (SELECT id FROM p1 WHERE NOT crit ORDER BY id LIMIT 5),
c AS (SELECT (SELECT count(*) FROM dec) AS nd, (SELECT count(*) FROM extra) AS nx, CASE WHEN (SELECT o FROM over1) THEN 1 ELSE 0 END AS nc),
every AS (SELECT d.no AS decision_no, format('{}_{:04d}', d.action, d.no) AS decision_id, d.action, CASE WHEN d.res = d.b THEN [d.b, d.a] ELSE [d.a, d.b] END AS affected, CASE WHEN d.res = d.b THEN [y.name, x.name] ELSE [x.name, y.name] END AS names, d.res AS result_node,
    CASE WHEN d.action = 'merge' THEN '' ELSE '不同概念，各自保留。相似度 ' || format('{:.2f}', s) || '，' END AS reason, CASE WHEN d.action = 'merge' THEN least(0.9, s) ELSE 0.9 END AS confidence FROM dec d JOIN nodes_once x ON x.id = d.a JOIN nodes_once y ON y.id = d.b
  UNION ALL SELECT nd + k + 1, format('purge_supp_{:04d}', nd + k), 'remove', [id], [name], NULL, '第一步：移除补充级知识点', 0.95 FROM extra, c
  UNION ALL SELECT nd + nx + 1, format('compress_important_{:04d}', nd + nx), 'merge', (SELECT array_agg(id ORDER BY id) FROM few), ['重要级知识点批量压缩'], NULL, '第二步：压缩 ' || (SELECT count(*) FROM p1 WHERE NOT crit) || ' 个重要级知识点的定义至 100 字以内', 0.95 FROM c WHERE nc = 1
  UNION ALL SELECT nd + nx + nc + k + 1, format('trim_important_{:04d}', nd + nx + nc + k), 'remove', [id], [name], NULL, '第三步：为达成压缩目标移除重要级知识点', 0.85 FROM victims, c)"""
_FINAL, _FINAL_OBSERVED = _INTENT + _TRIM, _OBSERVED + _TRIM
_STATS = """(SELECT count(DISTINCT textbook_id) FROM nodes_once) AS textbook_count, (SELECT count(*) FROM nodes_once) AS original_nodes,
  (SELECT coalesce(sum(length(definition)), 0) FROM nodes_once) AS original_chars, (SELECT count(*) FROM final) AS merged_nodes, (SELECT coalesce(sum(length(definition)), 0) FROM final) AS merged_chars,
  (SELECT count(*) FROM every) AS total_decisions, (SELECT count(*) FROM every WHERE action = 'merge' AND {merges}) AS merge_count, (SELECT count(*) FROM every WHERE action = 'keep') AS keep_count, (SELECT count(*) FROM every WHERE action = 'remove') AS remove_count,
  round((SELECT coalesce(sum(length(definition)), 0) FROM final) * 1.0 / (SELECT n FROM base), 4) AS compression_ratio"""
_REAL = "NOT starts_with(decision_id, 'compress_')"
_MD = f"""{_CHAPTERS}, txt AS (SELECT textbook_id || '#' || ord AS book, string_split(content, chr(10)) AS ls FROM chapters_once WHERE content IS NOT NULL),
lines AS (SELECT book, i - 1 AS i, ls[i] AS t, len(ls) AS m FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM txt)),
hd AS (SELECT *, CASE WHEN regexp_matches(t, '^#{{1,3}}\\s+(.+)$') THEN 1 ELSE 0 END AS h FROM lines),
seg AS (SELECT *, sum(h) OVER (PARTITION BY book ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM hd),
body AS (SELECT book, g, min(i) AS line_no, string_agg(t, chr(10) ORDER BY i) AS content FROM seg WHERE h = 0 GROUP BY 1, 2),
ttl AS (SELECT book, g, {_strip("regexp_extract(t, '^#{1,3}\\s+(.+)$', 1)")} AS title FROM seg WHERE h = 1)"""

_CN = ", ".join(f"'{k}': {v}" for k, v in cn_numbers().items())
_PAGE_AT = "(SELECT max(CAST(c.page_start AS BIGINT) * 100000000 + c.ord) % 100000000 FROM chapters_once c WHERE c.textbook_id = n.textbook_id AND c.page_start <= n.page)"

SQL = {
    "rag_topk_dedup": _TOP.format(where="q.vec_id = 0", cols=""),
    "rag_topk_batch": _TOP.format(where="q.vec_id % 20 = 0", cols="qid,"),
    "candidate_pairs": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(array_cosine_similarity(a.e, b.e), 4) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.label <> b.label AND array_cosine_similarity(a.e, b.e) >= 0.40""",
    "node_pairs": f"WITH {_PAIRS} SELECT a, b, round(s, 4) AS similarity FROM pairs",
    "node_dedup": f"""WITH {_NODES}, k AS (SELECT *, {_strip("name")} AS key FROM nodes_once WHERE name IS NOT NULL AND definition IS NOT NULL AND importance_level IS NOT NULL)
SELECT arg_min(id, ord) AS id, arg_min(name, ord) AS name, arg_min(definition, length(definition) * -100000000000 + ord) AS definition,
  CASE WHEN bool_or(importance_level = '关键') THEN '关键' ELSE arg_min(importance_level, ord) END AS importance_level, textbook_id,
  (array_agg(chapter ORDER BY ord))[1] AS chapter, min(page) AS page, min(ord) AS ord FROM k GROUP BY textbook_id, key""",
    "edge_dedup": f"""WITH {_EDGES} SELECT textbook_id, source, target, relation_type, description, ord FROM edges_once WHERE source IS NOT NULL AND target IS NOT NULL AND relation_type IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY textbook_id, source, target, relation_type ORDER BY ord) = 1""",
    "chunks_600_80": _chunks(RETRIEVAL),
    "chunks_500_60": _chunks(PAGES),
    "batches_4000_200": _chunks(BATCHES),
    "chunk_index": f"""WITH RECURSIVE {_CHAPTERS}, full_chapters AS (SELECT * FROM chapters_once WHERE {_strip("content")} <> ''),
{windows_sql(RETRIEVAL, "full_chapters", "textbook_id, ord, chapter_id, page_start, page_end", "content")}
SELECT substr(md5(textbook_id || '_' || chapter_id || '_' || chunk_no), 1, 12) AS chunk_id, textbook_id, ord, CAST(chunk_no AS INTEGER) AS chunk_no,
  least(page_start + CAST(floor(chunk_no * 1.0 / n_chunks * greatest(page_end - page_start + 1, 1)) AS INTEGER), page_end) AS page_start, page_end, CAST(length(chunk) AS INTEGER) AS n_chars FROM kept""",
    "index_status": f"""WITH RECURSIVE {_CHAPTERS}, full_chapters AS (SELECT * FROM chapters_once WHERE {_strip("content")} <> ''),
{windows_sql(RETRIEVAL, "full_chapters", "textbook_id, ord", "content")},
b AS (SELECT textbook_id, max({_strip("title")}) AS title FROM textbooks GROUP BY 1)
SELECT count(DISTINCT b.title) AS indexed_books, count(*) AS total_chunks, 'hashed' AS embedding_model FROM kept LEFT JOIN b USING (textbook_id)""",
    "batch_pages": f"""WITH RECURSIVE {_CHAPTERS}, full_chapters AS (SELECT * FROM chapters_once WHERE {_strip("content")} <> ''),
{windows_sql(BATCHES, "full_chapters", "textbook_id, ord, page_start, page_end", "content")}
SELECT textbook_id, ord, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(a AS INTEGER) AS char_offset,
  greatest(page_start, least(page_start + CAST(floor(a * 1.0 / greatest(len, 1) * (page_end - page_start + 1)) AS INTEGER), page_end)) AS page FROM kept""",
    "markdown_chapters": f"""WITH {_MD} SELECT book, CAST(line_no AS INTEGER) AS line_no, coalesce(title, '前言') AS title,
  CAST(length(replace(replace(content, chr(10), ''), ' ', '')) AS INTEGER) AS char_count, md5(content) AS digest FROM body LEFT JOIN ttl USING (book, g)""",
    "header_footer_filter": f"""WITH {_CHAPTERS}, l AS (SELECT textbook_id, unnest(string_split(content, chr(10))) AS line FROM chapters_once), s AS (SELECT textbook_id, {_strip("line")} AS t FROM l)
SELECT textbook_id, count(*) AS lines, count(*) FILTER (WHERE length(t) < 30 AND (t = '' OR regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '^第\\s*[0-9]+\\s*页') OR starts_with(t, '版权所有'))) AS dropped FROM s GROUP BY 1""",
    "heading_numbers": f"""WITH {_CHAPTERS}, t AS (SELECT textbook_id, ord, {_strip("title")} AS s FROM chapters_once),
p AS (SELECT textbook_id, ord, regexp_extract(s, '^第\\s*([零一二三四五六七八九十百0-9]+)\\s*章', 1) AS c, regexp_extract(s, '(?i)^Chapter\\s+([0-9]+)', 1) AS a FROM t)
SELECT textbook_id, ord, CAST(CASE WHEN c <> '' THEN coalesce(MAP {{{_CN}}}[c], try_cast(c AS INTEGER), 0) ELSE try_cast(a AS INTEGER) END AS INTEGER) AS number FROM p WHERE c <> '' OR a <> ''""",
    "book_ids": f"""WITH {_BOOKS} SELECT DISTINCT filename, 'book_' || substr(md5(filename), 1, 8) AS made_id, regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '^[0-9]{{2,3}}[_\\-]', '') AS made_title FROM books_once""",
    "char_counts": f"""WITH {_CHAPTERS} SELECT textbook_id, sum(length(replace(replace(content, chr(10), ''), ' ', ''))) AS chars, sum(greatest(1, length(content) // 4000 + 1)) AS batches FROM chapters_once WHERE {_strip("content")} <> '' GROUP BY 1""",
    "judge_decisions": f"WITH {_DECIDED} SELECT no AS decision_no, action, CASE WHEN res = b THEN b ELSE a END AS a, CASE WHEN res = b THEN a ELSE b END AS b, res AS result_node, round(CASE WHEN action = 'merge' THEN least(0.9, s) ELSE 0.9 END, 4) AS confidence FROM dec",
    "kept_nodes_observed": f"WITH {_OBSERVED} SELECT id FROM kept",
    "kept_nodes_intent": f"WITH {_INTENT} SELECT id FROM kept",
    "budget_trim": f"WITH {_FINAL} SELECT id, CAST(length(definition) AS INTEGER) AS n_chars FROM final",
    "integration_decisions": f"""WITH {_FINAL} SELECT decision_no, decision_id, action, array_to_string(affected, '|') AS affected, result_node, reason, round(confidence, 4) AS confidence FROM every""",
    "integration_stats": f"WITH {_FINAL} SELECT {_STATS.format(merges=_REAL)}",
    "integration_stats_observed": f"WITH {_FINAL_OBSERVED} SELECT {_STATS.format(merges='true')}",
    "integration_report": f"""WITH {_FINAL}, st AS (SELECT {_STATS.format(merges=_REAL)}),
k AS (SELECT CASE WHEN contains(chapter, '第') THEN {_strip("string_split(chapter, '第')[1]")} ELSE substr(chapter, 1, 6) END AS domain, name, ord FROM final WHERE chapter IS NOT NULL),
cov AS (SELECT domain, count(*) AS n, array_to_string((array_agg(coalesce(name, '') ORDER BY ord))[1:5], ', ') || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS sample FROM k GROUP BY 1 ORDER BY n DESC, min(ord) LIMIT 8),
dom AS (SELECT coalesce(string_agg('| ' || domain || ' | ' || n || ' | ' || sample || ' |', chr(10) ORDER BY n DESC, domain), '') AS t FROM cov),
merges AS (SELECT *, row_number() OVER (ORDER BY decision_no) AS i FROM every WHERE action = 'merge' ORDER BY decision_no LIMIT 5),
cs AS (SELECT string_agg('### 案例 ' || i || '：合并 — ' || array_to_string(list_transform(names[1:3], lambda x: coalesce(x, '')), ', ') || chr(10) || chr(10) || '- **涉及知识点**: ' || array_to_string(list_transform(names, lambda x: coalesce(x, '')), ', ') || chr(10) || '- **置信度**: ' || format('{{:.2f}}', confidence) || chr(10) || '- **理由**: ' || reason, chr(10) || chr(10) ORDER BY i) AS t FROM merges),
crit AS (SELECT DISTINCT n.id, coalesce(m.dest, n.id) AS dest FROM nodes_once n LEFT JOIN (SELECT id, max(res) AS dest FROM touch WHERE action = 'merge' GROUP BY 1) m USING (id) WHERE n.importance_level = '关键')
SELECT '# 学科知识整合报告' || repeat(chr(10), 2) || '## 整合概览' || repeat(chr(10), 2) || '| 指标 | 数值 |' || chr(10) || '|------|------|' || chr(10) || '| 原始教材数量 | ' || textbook_count || ' 本 |' || chr(10) || '| 整合前知识点数 | ' || original_nodes || ' |' || chr(10) || '| 整合后知识点数 | ' || merged_nodes || ' |' || chr(10)
  || '| 原始总字数 | ' || format('{{:,}}', original_chars::BIGINT) || ' 字 |' || chr(10) || '| 整合后字数 | ' || format('{{:,}}', merged_chars::BIGINT) || ' 字 |' || chr(10) || '| **压缩比** | **' || format('{{:.1f}}', compression_ratio * 100) || '%** |' || repeat(chr(10), 2)
  || '## 整合决策摘要' || repeat(chr(10), 2) || '| 决策类型 | 数量 |' || chr(10) || '|----------|------|' || chr(10) || '| merge（合并） | ' || merge_count || ' |' || chr(10) || '| keep（保留） | ' || keep_count || ' |' || chr(10) || '| remove（删除） | ' || remove_count || ' |' || chr(10) || '| **合计** | **' || total_decisions || '** |' || repeat(chr(10), 2)
  || '## 知识域覆盖' || repeat(chr(10), 2) || '| 知识域 | 保留知识点数 | 代表性概念 |' || chr(10) || '|--------|------------|-----------|' || chr(10) || (SELECT t FROM dom) || repeat(chr(10), 2) || '## 重点整合案例' || repeat(chr(10), 2) || coalesce((SELECT t FROM cs), '（无合并案例）')
  || repeat(chr(10), 2) || '## 教学完整性说明' || repeat(chr(10), 2) || '- 关键级知识点：保留 ' || (SELECT count(*) FROM crit WHERE dest IN (SELECT id FROM final)) || ' / ' || (SELECT count(*) FROM crit) || chr(10) AS report_markdown FROM st""",
    "merged_edges": f"""WITH {_FINAL}, {_EDGES}, moves AS (SELECT id, arg_max(res, no) AS dest FROM touch WHERE action = 'merge' AND id <> res GROUP BY id),
e AS (SELECT coalesce(x.dest, source) AS source, coalesce(y.dest, target) AS target, relation_type, description, ord FROM edges_once LEFT JOIN moves x ON x.id = source LEFT JOIN moves y ON y.id = target)
SELECT source, target, relation_type, description FROM e WHERE source IN (SELECT id FROM final) AND target IN (SELECT id FROM final) QUALIFY row_number() OVER (PARTITION BY source, target, relation_type ORDER BY ord) = 1""",
    "domain_coverage": f"""WITH {_NODES}, k AS (SELECT CASE WHEN contains(chapter, '第') THEN {_strip("string_split(chapter, '第')[1]")} ELSE substr(chapter, 1, 6) END AS domain, name, ord FROM nodes_once WHERE chapter IS NOT NULL)
SELECT domain, count(*) AS concepts, array_to_string(list_transform((array_agg(coalesce(name, '') ORDER BY ord))[1:5], lambda x: x), ', ') || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS sample FROM k GROUP BY 1 ORDER BY concepts DESC, min(ord) LIMIT 8""",
    "graph_union": f"""WITH {_NODES}, {_EDGES}, n AS (SELECT textbook_id, count(*) AS nodes FROM nodes_once GROUP BY 1), e AS (SELECT textbook_id, count(*) AS edges FROM edges_once GROUP BY 1)
SELECT textbook_id, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM n FULL JOIN e USING (textbook_id)""",
    "dashboard_totals": f"WITH {_BOOKS} SELECT count(*) AS books, coalesce(sum(total_pages), 0) AS pages, coalesce(sum(total_chars), 0) AS chars FROM books_once",
    "node_display": f"""WITH {_NODES}, c AS (SELECT textbook_id, (row_number() OVER (ORDER BY min(ord)) - 1) % 7 AS colour FROM nodes_once GROUP BY 1)
SELECT id, CASE WHEN length(name) > 8 THEN substr(name, 1, 7) || '…' ELSE name END AS label, CASE importance_level WHEN '关键' THEN 28 WHEN '重要' THEN 20 WHEN '补充' THEN 14 ELSE 18 END AS size, CAST(colour AS INTEGER) AS colour
FROM nodes_once JOIN c USING (textbook_id) WHERE name IS NOT NULL""",
    "decision_stats": f"""SELECT lower({_strip("action")}) AS action, count(*) AS n, round(avg(least(confidence, 1.0)), 6) AS confidence FROM (SELECT DISTINCT * FROM decisions) GROUP BY 1""",
    "llm_json_nodes": f"""WITH {_NODES} SELECT id AS local_id, substr(name, 1, 20) AS name, CAST(least(length(definition), 300) AS INTEGER) AS n_chars, importance_level, page FROM nodes_once
WHERE name IS NOT NULL AND definition IS NOT NULL AND page IS NOT NULL AND importance_level IN ('关键', '重要', '补充')""",
    "llm_json_edges": f"WITH {_NODES} SELECT id AS source, id AS target, 'contains' AS relation_type, '' AS description FROM nodes_once",
    "resume_pending_books": f"WITH {_BOOKS} SELECT DISTINCT textbook_id FROM books_once ANTI JOIN (SELECT textbook_id FROM nodes WHERE loaded_at < TIMESTAMP '{STOPPED}') USING (textbook_id)",
    "rag_contexts": f"""WITH {_NODES}, v AS (SELECT ord, coalesce(definition, '') AS t, textbook_id AS book, coalesce(chapter, '') AS ch, coalesce(page, 0) AS page, {_V} AS e FROM nodes_once WHERE {_UNIT}),
s AS (SELECT q.ord AS qid, c.ord, concat_ws('|', c.book, c.ch) AS key, array_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.ord % 20 = 0),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) <= 10),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY score DESC, ord) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS place FROM f QUALIFY place <= 5)
SELECT qid, string_agg('[' || place || '] 教材: ' || book || chr(10) || '章节: ' || ch || chr(10) || '页码: 第' || page || '页' || chr(10) || chr(10) || v.t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context, CAST(count(*) AS INTEGER) AS citations FROM p JOIN v USING (ord) GROUP BY 1""",
    "dashboard_overview": f"""WITH {_BOOKS}, f AS (SELECT coalesce(title, '?') AS t, row_number() OVER (ORDER BY textbook_id, title NULLS FIRST) AS i FROM books_once)
SELECT count(*) AS books, coalesce(sum(total_pages), 0) AS pages, coalesce(sum(total_chars), 0) AS chars, (SELECT string_agg(t, ', ' ORDER BY i) FROM f WHERE i <= 4) || CASE WHEN count(*) > 4 THEN '...' ELSE '' END AS titles FROM books_once""",
    "extraction_stats": f"""WITH RECURSIVE {_CHAPTERS}, full_chapters AS (SELECT * FROM chapters_once WHERE {_strip("content")} <> ''),
{windows_sql(BATCHES, "full_chapters", "textbook_id, ord", "content")}, n AS (SELECT textbook_id, count(*) AS n FROM kept GROUP BY 1)
SELECT b.textbook_id, coalesce(n, 0) AS batch_count, 0 AS failed_batches, coalesce(n, 0) * 13 AS total_cost_tokens FROM (SELECT DISTINCT textbook_id FROM textbooks) b LEFT JOIN n USING (textbook_id)""",
    "page_chunk_marks": f"""WITH RECURSIVE {_CHAPTERS}, full_text AS (SELECT textbook_id AS book, string_agg('[第' || (ord + 1) || '页]' || chr(10) || content, chr(10) || chr(10) ORDER BY ord) AS content FROM chapters_once WHERE content IS NOT NULL GROUP BY 1),
{windows_sql(PAGES, "full_text", "book", "content")},
m AS (SELECT book, chunk_no, length(chunk) AS n_chars, coalesce(try_cast(regexp_extract(chunk, '\\[第([0-9]+)页\\]', 1) AS INTEGER), 0) AS observed, try_cast(list_last(regexp_extract_all(chunk, '\\[第([0-9]+)页\\]', 1)) AS INTEGER) AS lst FROM kept)
SELECT book, CAST(chunk_no AS INTEGER) AS chunk_no, observed, CASE WHEN observed > 0 THEN observed ELSE coalesce(last_value(CASE WHEN observed > 0 THEN lst END IGNORE NULLS) OVER (PARTITION BY book ORDER BY chunk_no ROWS UNBOUNDED PRECEDING), 0) END AS page, CAST(n_chars AS INTEGER) AS n_chars FROM m""",
    "page_section_asof": f"WITH {_NODES}, {_CHAPTERS} SELECT n.id, n.page, CAST({_PAGE_AT} AS INTEGER) AS chapter_ord FROM nodes_once n WHERE n.page IS NOT NULL",
    "outline_tree": f"""WITH {_NODES}, {_CHAPTERS}, toc AS (SELECT textbook_id AS book, CAST(ord AS BIGINT) * 10000000 AS ord, 1 AS level, title FROM chapters_once UNION ALL
  SELECT n.textbook_id, coalesce({_PAGE_AT}, 0) * 10000000 + 1 + n.ord, 2, n.name FROM nodes_once n WHERE n.page IS NOT NULL),
k AS (SELECT * FROM toc WHERE NOT regexp_matches(coalesce(title, ''), '封面|版权|丛书|前言|目录')),
p AS (SELECT book, ord, level, last_value(CASE WHEN level = 1 THEN ord END IGNORE NULLS) OVER (PARTITION BY book ORDER BY ord ROWS UNBOUNDED PRECEDING) AS above FROM k)
SELECT book, ord, CASE WHEN level = 2 THEN above END AS parent_ord, level AS depth FROM p WHERE level = 1 OR above IS NOT NULL""",
}
SQL["mind_map"] = SQL["outline_tree"].replace("p AS (SELECT book, ord, level,", "p AS (SELECT book, ord, level, title, page,").replace("1 AS level, title FROM", "1 AS level, title, page_start AS page FROM").replace("2, n.name FROM", "2, n.name, n.page FROM").split("SELECT book, ord, CASE WHEN level = 2")[0] + f"""SELECT book || '/' || ord AS node_id, CASE WHEN level = 1 THEN book ELSE book || '/' || above END AS parent_id, level AS depth, {_strip("title")} AS name, page FROM p WHERE level = 1 OR above IS NOT NULL
UNION ALL SELECT DISTINCT book, NULL, 0, book, NULL FROM toc"""


def _literal(value) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value).lower()
    return "||".join("chr(10)" if part == "\n" else "'" + part.replace("'", "''") + "'" for part in re.split("(\n)", value) if part) or "''"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


_LINES = _values("l", "textbook_id, page_idx, line_idx, text, size, is_bold", PAGE_LINES)
_BODY = f"""{_LINES}, sized AS (SELECT textbook_id, list_sort(list(size) FILTER (WHERE length({_strip("text")}) > 10)) AS s FROM l GROUP BY 1), body AS (SELECT textbook_id, CAST(coalesce(s[len(s) // 2 + 1], 11.0) AS DOUBLE) AS body_size FROM sized)"""
SQL["body_font_size"] = f"WITH {_BODY} SELECT * FROM body"
SQL["chapter_ranges"] = f"""WITH {_BODY}, {_values("total", "textbook_id, n, title", TOTAL_PAGES)},
h AS (SELECT l.textbook_id, page_idx, {_strip("text")} AS title FROM l JOIN body USING (textbook_id) WHERE (regexp_matches({_strip("text")}, '^第\\s*[零一二三四五六七八九十百0-9]+\\s*章') OR regexp_matches({_strip("text")}, '(?i)^Chapter\\s+[0-9]+')) AND (size >= 1.15 * body_size OR is_bold OR length({_strip("text")}) < 40)
  QUALIFY row_number() OVER (PARTITION BY l.textbook_id, page_idx ORDER BY line_idx) = 1),
r AS (SELECT h.textbook_id, row_number() OVER w AS i, h.title, page_idx AS a, coalesce(lead(page_idx) OVER w, n) - 1 AS z FROM h JOIN total USING (textbook_id) WINDOW w AS (PARTITION BY h.textbook_id ORDER BY page_idx)
  UNION ALL SELECT textbook_id, 1, title, 0, n - 1 FROM total WHERE textbook_id NOT IN (SELECT textbook_id FROM h)),
t AS (SELECT textbook_id, page_idx, line_idx, text, {_strip("text")} AS s FROM l), x AS (SELECT * FROM t WHERE NOT (length(s) < 30 AND (s = '' OR regexp_matches(s, '^[0-9]+$') OR regexp_matches(s, '^第\\s*[0-9]+\\s*页') OR starts_with(s, '版权所有')))),
o AS (SELECT r.textbook_id, i, r.title, a, z, coalesce(string_agg(x.text, chr(10) ORDER BY page_idx, line_idx), '') AS content FROM r LEFT JOIN x ON x.textbook_id = r.textbook_id AND page_idx BETWEEN a AND z GROUP BY ALL)
SELECT textbook_id, format('ch_{{:02d}}', i) AS chapter_id, title, CAST(a + 1 AS INTEGER) AS page_start, CAST(z + 1 AS INTEGER) AS page_end, content, CAST(length(replace(replace(content, chr(10), ''), ' ', '')) AS INTEGER) AS char_count FROM o"""
SQL["page_marker_strip"] = f"""WITH {_values("m", "i, text", list(enumerate(MARKED)))} SELECT i, coalesce(try_cast(regexp_extract(text, '\\[第([0-9]+)页\\]', 1) AS INTEGER), 0) AS page, substr(regexp_replace(text, '\\[第[0-9]+页\\]\\s*', '', 'g'), 1, 800) AS text FROM m"""
SQL["ocr_pages"] = f"""WITH {_values("o", "book, page_idx, line_idx, text, score", OCR_LINES)}, p AS (SELECT book, page_idx, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM o WHERE score > 0.6 GROUP BY 1, 2)
SELECT *, (SELECT string_agg('[第' || (x.page_idx + 1) || '页]' || chr(10) || x.text, chr(10) || chr(10) ORDER BY x.page_idx) FROM p x WHERE x.book = p.book) AS full_text FROM p"""
SQL["summary_lines"] = f"""WITH {_values("a", "book, raw", SUMMARIES)}, l AS (SELECT book, i, {_strip("ls[i]")} AS t FROM (SELECT book, string_split(raw, chr(10)) AS ls, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS i FROM a)),
m AS (SELECT book, i, try_cast(regexp_extract(t, '^\\[([0-9]+)\\]\\s*(.+)$', 1) AS INTEGER) AS number, regexp_extract(t, '^\\[([0-9]+)\\]\\s*(.+)$', 2) AS summary FROM l) SELECT book, number, arg_max(summary, i) AS summary FROM m WHERE number IS NOT NULL GROUP BY 1, 2"""


def _expected(columns: str, rows: list[tuple]) -> str:
    """What rules of a format give, worked out by hand, where SQL has no means for the rules."""
    return f"WITH {_values('want', columns, rows)} SELECT * FROM want"


_ALIKE = "不同概念，各自保留。相似度 0.90，"
SQL["judge_answers"] = _expected(
    "decision_id, action, names, result_node, confidence, reason",
    [("merge_0001", "merge", "B0|A0", "b0", 0.9, "r"), ("keep_0002", "keep", "A1|B1", None, 0.5, _ALIKE + "没有 JSON 回答"), ("keep_0003", "keep", "A2|B2", None, 0.5, _ALIKE + "没有 JSON 回答"), ("keep_0004", "keep", "A3|B3", None, 0.7, _ALIKE), ("keep_0005", "keep", "A4|B4", None, 0.5, _ALIKE + "未知的操作：join"), ("keep_0006", "keep", "A5|B5", None, 0.5, _ALIKE + "置信度不在 0 到 1 之间"), ("merge_0007", "merge", "A6|B6", "a6", 0.5, ""), ("keep_0008", "keep", "A7|B7", None, 0.8, _ALIKE)],
)
SQL["legacy_nodes"] = _expected("id, name, definition, category, page", [("k", "A", "", "定理/定律", 4), ("node_001", "B", "", "核心概念", 7), ("v", "F", "", "核心概念", 9)])
SQL["legacy_edges"] = _expected("source, target, relation_type, description", [("k", "node_001", "parallel", ""), ("v", "k", "contains", "d")])
SQL["answer_nodes"] = _expected("batch_no, local_id, name, definition, importance_level, page", [(0, "n1", "一个长度超过二十个字的名字会被截断到二十", "d", "关键", 3), (0, "n3", "a", "", "重要", 7), (1, "n5", "", "d", "重要", 28), (1, "n7", "c", "", "重要", 28)])
SQL["answer_edges"] = _expected("batch_no, source, target, relation_type, description", [(0, "n1", "n2", "parallel", ""), (1, "n4", "n5", "contains", "x")])
SQL["math_items"] = _expected("kind, label, description", [("定义", "定义 1.2", "极限是一个数值概念"), ("定理", "定理 3", "有界数列必有收敛子列"), ("引理", "引理 4", "短 命题 5 任意 两点之间"), ("命题", "命题　5", "任意 两点之间")])
SQL["tree_counts"] = f"SELECT depth, count(*) AS nodes FROM ({SQL['outline_tree']}) GROUP BY 1"
