"""Queries of the engine's own operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import book_id, book_title, chapter_number, is_footer, page_mark, strip, visible_length, without_page_marks
from lexforge.operators import chunks, dashboard, integrate, records, retrieve, segment, similarity
from lexforge.plans import pipelines
from lexforge.session import keep, once, table, tidy

DIM = 64
#: Bounds of the pair join: the embeddings table has no pair at 0.70, nodes have.
PAIRS_FROM, NODES_FROM, SAME_FROM = 0.40, 0.70, 0.95


def nodes_once(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without the time of loading, deliveries once."""
    return table(spark, d, "nodes").drop("loaded_at").distinct()


def edges_once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").drop("loaded_at").distinct()


def chapters_once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").distinct()


def books_once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "textbooks").distinct()


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("label").alias("key"), "embedding")


def rag_topk_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The best vector of each label for the first vector, five out of the ten nearest."""
    e = embedded(spark, d)
    q = e.where("ord = 0").select(F.col("ord").alias("qid"), "embedding")
    return similarity.best_per_key(similarity.top_per_question(q, e, DIM, 10), 5).select("ord", "key", F.round("score", 4).alias("score"), "place")


def rag_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The same for every vector whose id is divisible by 20."""
    e = embedded(spark, d)
    q = e.where("ord % 20 = 0").select(F.col("ord").alias("qid"), "embedding")
    return similarity.best_per_key(similarity.top_per_question(q, e, DIM, 10), 5).select("qid", "ord", "key", F.round("score", 4).alias("score"), "place")


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of different labels from a cosine of 0.40."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("book"), F.col("vec_id").alias("ord"), "embedding")
    return similarity.candidate_pairs(e, DIM, PAIRS_FROM).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), F.round("similarity", 4).alias("similarity"))


def node_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes of different books from a cosine of 0.70."""
    n = keep(nodes_once(spark, d).select("id", F.col("textbook_id").alias("book"), "ord", "embedding"))
    return similarity.candidate_pairs(n, DIM, NODES_FROM).select("a", "b", F.round("similarity", 4).alias("similarity"))


def node_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one name within a book, merged."""
    rows = nodes_once(spark, d).where("name is not null and definition is not null and importance_level is not null")
    return records.deduplicated_nodes(rows)


def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Edges of one kind within a book, the first of each."""
    return records.deduplicated_edges(edges_once(spark, d).where("source is not null and target is not null and relation_type is not null"), ["textbook_id"])


def _chunked(spark: SparkSession, d: str, rule: chunks.Rule) -> DataFrame:
    rows = chunks.chunk(table(spark, d, "documents"), "text", rule, ["doc_id"])
    return rows.select("doc_id", "chunk_no", "char_offset", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def chunks_600_80(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks for retrieval."""
    return _chunked(spark, d, chunks.RETRIEVAL)


def chunks_500_60(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of the page index."""
    return _chunked(spark, d, chunks.PAGES)


def batches_4000_200(spark: SparkSession, d: str) -> DataFrame:
    """Documents in batches for extraction."""
    return _chunked(spark, d, chunks.BATCHES)


def _index(spark: SparkSession, d: str) -> DataFrame:
    books = books_once(spark, d).groupBy("textbook_id").agg(F.max(strip(F.col("title"))).alias("title"))
    return retrieve.build_chunks(chapters_once(spark, d), books)


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """Ids, pages and sizes of all chunks of chapters."""
    return _index(spark, d).select("chunk_id", "textbook_id", "ord", "chunk_no", "page_start", "page_end", F.length("text").alias("n_chars"))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    """How many books and chunks are indexed."""
    return retrieve.index_status(_index(spark, d))


def batch_pages(spark: SparkSession, d: str) -> DataFrame:
    """Batches of chapters with their approximate page."""
    rows = chapters_once(spark, d).where(strip(F.col("content")) != "").withColumn("length", F.length("content"))
    cut_ = chunks.chunk(rows, "content", chunks.BATCHES, ["textbook_id", "ord", "page_start", "page_end", "length"])
    return retrieve.batch_pages(cut_).select("textbook_id", "ord", "chunk_no", "char_offset", "page")


def markdown_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapter contents split at their headings."""
    rows = chapters_once(spark, d).select(F.concat_ws("#", "textbook_id", F.col("ord").cast("string")).alias("book"), "content")
    out = segment.markdown_chapters(rows)
    return out.select("book", "line_no", "title", "char_count", F.md5(F.col("content").cast("binary")).alias("digest"))


def header_footer_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chapters that the simple filter takes for headers and footers, counted by book."""
    lines = chapters_once(spark, d).select("textbook_id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.groupBy("textbook_id").agg(F.count("*").alias("lines"), F.count_if(is_footer(F.col("line"))).alias("dropped"))


def heading_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Chapter numbers read from titles."""
    rows = chapters_once(spark, d)
    return rows.select("textbook_id", "ord", chapter_number(F.col("title")).alias("number")).where("number is not null")


def book_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids and titles made from filenames."""
    return books_once(spark, d).select("filename", book_id(F.col("filename")).alias("made_id"), book_title(F.col("filename")).alias("made_title")).distinct()


def char_counts(spark: SparkSession, d: str) -> DataFrame:
    """Visible characters and estimated batches by book."""
    rows = chapters_once(spark, d).where(strip(F.col("content")) != "")
    return rows.groupBy("textbook_id").agg(F.sum(visible_length(F.col("content"))).alias("chars"), F.sum(F.greatest(F.lit(1), F.floor(F.length("content") / 4000) + 1)).alias("batches"))


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes without their vectors, and the decisions about pairs; the nodes are not written, and of the pair join only the pairs stay."""
    nodes = once(table(spark, d, "nodes").drop("loaded_at"), "ord")
    pairs = keep(similarity.candidate_pairs(nodes.select("id", F.col("textbook_id").alias("book"), "ord", "embedding"), DIM, NODES_FROM))
    tidy(spark)
    nodes, pairs = nodes.drop("embedding"), integrate.numbered_pairs(pairs)
    tidy(spark)
    decided = keep(integrate.decisions(integrate.rule_judgements(pairs, nodes, SAME_FROM)))
    tidy(spark)
    return nodes, decided


def judge_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the rule judge about all candidate pairs."""
    _, decided = _decided(spark, d)
    return decided.select("decision_no", "action", F.element_at("affected_nodes", 1).alias("a"), F.element_at("affected_nodes", 2).alias("b"), "result_node", F.round("confidence", 4).alias("confidence"))


def kept_nodes_observed(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that stay, as observed."""
    nodes, decided = _decided(spark, d)
    return integrate.kept_nodes(nodes, decided, intent=False).select("id")


def kept_nodes_intent(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that stay, as intended."""
    nodes, decided = _decided(spark, d)
    return integrate.kept_nodes(nodes, decided).select("id")


def _final(spark: SparkSession, d: str, intent: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, all decisions and the nodes that stay."""
    nodes, decided = _decided(spark, d)
    final, more = integrate.budget(integrate.kept_nodes(nodes, decided, intent), integrate.original_chars(nodes), decided.count())
    return nodes, keep(decided.unionByName(more)), keep(final)


def integration_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every decision: about pairs, what was purged, shortened and trimmed."""
    every = _final(spark, d)[1]
    return every.select("decision_no", "decision_id", "action", F.array_join("affected_nodes", "|").alias("affected"), "result_node", "reason", F.round("confidence", 4).alias("confidence"))


def budget_trim(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that stay within the budget, with the length of their definition."""
    return _final(spark, d)[2].select("id", F.length("definition").alias("n_chars"))


def integration_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and compression of the whole integration."""
    nodes, every, final = _final(spark, d)
    return integrate.stats(nodes, final, every)


def integration_stats_observed(spark: SparkSession, d: str) -> DataFrame:
    """The same as observed: nodes of keep decisions go, and the shortening counts as a merge."""
    nodes, every, final = _final(spark, d, intent=False)
    return integrate.stats(nodes, final, every, intent=False)


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the merged graph."""
    _, decided, final = _final(spark, d)
    return integrate.merged_edges(once(table(spark, d, "edges").drop("loaded_at"), "ord"), decided, final)


def domain_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Domains with most concepts."""
    return integrate.domain_coverage(nodes_once(spark, d))


def integration_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of the integration as one text."""
    nodes, every, final = _final(spark, d)
    return integrate.report(integrate.stats(nodes, final, every), integrate.domain_coverage(final), every, integrate.completeness(nodes, final, every))


def graph_union(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of every book's own graph."""
    n = nodes_once(spark, d).groupBy("textbook_id").agg(F.count("*").alias("nodes"))
    e = edges_once(spark, d).groupBy("textbook_id").agg(F.count("*").alias("edges"))
    return n.join(e, "textbook_id", "full_outer").select("textbook_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    """Books, pages and characters."""
    return dashboard.totals(books_once(spark, d))


def node_display(spark: SparkSession, d: str) -> DataFrame:
    """Labels and sizes of nodes with their book's colour."""
    n = nodes_once(spark, d)
    shown = dashboard.display(n.where("name is not null")).join(n.select("id", "textbook_id"), "id")
    return shown.join(dashboard.colours(n), "textbook_id").select("id", "label", "size", "colour")


def decision_stats(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by action."""
    rows = table(spark, d, "decisions").distinct()
    return rows.groupBy(F.lower(strip(F.col("action"))).alias("action")).agg(F.count("*").alias("n"), F.round(F.avg(F.least("confidence", F.lit(1.0))), 6).alias("confidence"))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as answers of one item each."""
    n = nodes_once(spark, d)
    item = F.struct(F.col("id").alias("local_id"), "name", "definition", "importance_level", F.col("page").cast("string").alias("page"))
    edge = F.struct(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation_type"), "chapter")
    body = F.to_json(F.struct(F.array(item).alias("nodes"), F.array(edge).alias("edges")), {"ignoreNullFields": "false"})
    return n.select("textbook_id", F.col("ord").alias("batch_no"), "chapter", F.lit(1).alias("page"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw"))


def llm_json_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes written as answers and read back, checked."""
    got = records.parsed_nodes(_outputs(spark, d))
    return got.select("local_id", "name", F.length("definition").alias("n_chars"), "importance_level", "page")


def llm_json_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of those answers, checked."""
    return records.parsed_edges(_outputs(spark, d)).select("source", "target", "relation_type", "description")


#: When a run over the nodes stopped, in the query below.
STOPPED = "2025-07-01"


def resume_pending_books(spark: SparkSession, d: str) -> DataFrame:
    """Books that are still to be done if a run stopped after the loads of a month: those without a node from before."""
    from lexforge.streaming.incremental import pending

    return pending(books_once(spark, d), table(spark, d, "nodes").where(F.col("loaded_at") < F.lit(STOPPED).cast("timestamp_ntz")))


def page_section_asof(spark: SparkSession, d: str) -> DataFrame:
    """The chapter that every node's page lies in."""
    pages = nodes_once(spark, d).where("page is not null").select("id", F.col("textbook_id").alias("book"), "page")
    sections = chapters_once(spark, d).select(F.col("textbook_id").alias("book"), "ord", F.col("page_start").alias("page"), "title")
    return segment.pages_to_sections(pages, sections).select("id", "page", F.col("sec_ord").alias("chapter_ord"))


def outline_tree(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as level 1 and their nodes as level 2 of an outline."""
    return segment.outline_tree(_toc(spark, d)).select("book", "ord", "parent_ord", "depth")


def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries of every depth of the outline."""
    return dashboard.tree_counts(outline_tree(spark, d))


def math_statements(spark: SparkSession, d: str) -> DataFrame:
    """Numbered statements in chapters."""
    rows = chapters_once(spark, d).select("textbook_id", "ord", F.col("content").alias("text"))
    return segment.statements(rows, ["textbook_id", "ord"])


def rag_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts and citations for the nodes whose ord is divisible by 20, from all nodes."""
    n = nodes_once(spark, d)
    text = n.select("ord", F.coalesce("definition", F.lit("")).alias("text"), F.col("textbook_id").alias("textbook_name"), F.coalesce("chapter", F.lit("")).alias("chapter_title"), F.coalesce("page", F.lit(0)).alias("page_start"), "embedding")
    q = n.where("ord % 20 = 0").select(F.col("ord").alias("qid"), "embedding")
    return retrieve.answer_contexts(q, text, DIM).select("qid", "context", F.size("citations").alias("citations"))


def dashboard_overview(spark: SparkSession, d: str) -> DataFrame:
    """Books, pages, characters and the first titles."""
    return dashboard.overview(books_once(spark, d))


def _toc(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as level 1 and their nodes as level 2 of an outline."""
    ch = chapters_once(spark, d).select(F.col("textbook_id").alias("book"), (F.col("ord").cast("long") * 10_000_000).alias("ord"), F.lit(1).alias("level"), "title", F.col("page_start").alias("page"))
    at = segment.pages_to_sections(nodes_once(spark, d).where("page is not null").select(F.col("textbook_id").alias("book"), "page", "name", F.col("ord").alias("n")), chapters_once(spark, d).select(F.col("textbook_id").alias("book"), "ord", F.col("page_start").alias("page"), "title"))
    leaves = at.select("book", (F.coalesce("sec_ord", F.lit(0)).cast("long") * 10_000_000 + 1 + F.col("n")).alias("ord"), F.lit(2).alias("level"), F.col("name").alias("title"), "page")
    return ch.unionByName(leaves)


def mind_map(spark: SparkSession, d: str) -> DataFrame:
    """Books, their chapters and what stands below as one tree."""
    return pipelines.mind_map(_toc(spark, d)).select("node_id", "parent_id", "depth", "name", "page")


def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    """Batches and tokens of every book by the model that needs no network."""
    books = books_once(spark, d).groupBy("textbook_id").agg(F.max("title").alias("title"))
    return pipelines.extract(chapters_once(spark, d), books).stats


def page_chunk_marks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of whole books, each chapter a page behind its mark, with the page as observed and as intended."""
    pages = chapters_once(spark, d).where("content is not null").select(F.col("textbook_id").alias("book"), F.col("ord").alias("page_idx"), F.col("content").alias("text"))
    texts = keep(segment.full_text(pages))
    seen = retrieve.page_chunks(texts, intent=False).withColumnRenamed("page", "observed")
    return seen.join(retrieve.page_chunks(texts).select("book", "chunk_no", "page"), ["book", "chunk_no"]).select("book", "chunk_no", "observed", "page", F.length("text").alias("n_chars"))


#: Lines of two scanned books: headings by size, weight and shortness, a footer, and a book without headings.
PAGE_LINES = [
    ("a", 0, 0, "before any chapter, long enough", 10.0, False), ("a", 1, 0, "第一章 甲", 14.0, True), ("a", 1, 1, "body of the first chapter", 10.0, False), ("a", 1, 2, "12", 10.0, False),
    ("a", 2, 0, "more of the first chapter", 10.5, False), ("a", 3, 0, "Chapter 2 B", 10.0, False), ("a", 3, 1, "第三章 a second heading on one page", 14.0, True), ("a", 4, 0, "第 5 页", 10.0, False), ("a", 4, 1, "body of the second chapter", 11.0, False),
    ("b", 0, 0, "a book without headings", 9.0, False), ("b", 1, 0, "版权所有 2020", 9.0, False), ("b", 1, 1, "its second page is this", 8.0, False),
]
TOTAL_PAGES = [("a", 6, "A"), ("b", 2, "B")]


def _page_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGE_LINES, "textbook_id string, page_idx int, line_idx int, text string, size double, is_bold boolean")


def chapter_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of two scanned books with their pages and texts."""
    total = spark.createDataFrame(TOTAL_PAGES, "textbook_id string, total_pages int, book_title string")
    return segment.pdf_chapters(_page_lines(spark), total).select("textbook_id", "chapter_id", "title", "page_start", "page_end", "content", "char_count")


def body_font_size(spark: SparkSession, d: str) -> DataFrame:
    """The usual size of those books' lines."""
    return segment.body_font_size(_page_lines(spark))


#: Texts with and without page marks.
MARKED = ["[第3页]\n文字", "前 [第12页]  后 [第13页] x", "无标记", "[第x页] y", "", "[第7页]" + "长" * 900]


def page_marker_strip(spark: SparkSession, d: str) -> DataFrame:
    """The first page mark of texts, and what they are without marks."""
    rows = spark.createDataFrame(list(enumerate(MARKED)), "i int, text string")
    return rows.select("i", page_mark(F.col("text")).alias("page"), without_page_marks(F.col("text")).alias("text"))


#: Recognised lines with their scores.
OCR_LINES = [("b", 0, 1, "two", 0.61), ("b", 0, 0, "one", 0.9), ("b", 0, 2, "lost", 0.6), ("b", 2, 0, "third page", 1.0), ("c", 0, 0, "nothing", 0.1)]


def ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the lines with a good score, and each book's whole text."""
    pages = segment.recognised_pages(spark.createDataFrame(OCR_LINES, "book string, page_idx int, line_idx int, text string, score double"))
    return pages.join(segment.full_text(pages).withColumnRenamed("text", "full_text"), "book")


#: Answers with numbered lines.
SUMMARIES = [("b", "[0] x\n [2]  y \n[2] z\nnoise\n[3]"), ("c", "nothing")]


def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lines of answers, the last of each number."""
    return segment.summary_lines(spark.createDataFrame(SUMMARIES, "book string, raw string"))


#: Answers of a judge about pairs, good and bad.
JUDGED = ['so: {"is_same": true, "confidence": 0.95, "action": "merge", "best_source": "b", "reason": "r"} done', "no idea", '{"is_same": true', '{"action": "remove", "is_same": true, "confidence": 0.7}', '{"action": "join", "is_same": true}', '{"action": "merge", "is_same": true, "confidence": 1.5}', '{"is_same": true, "action": "merge"}', '{"is_same": false, "action": "merge", "confidence": 0.8}']


def judge_answers(spark: SparkSession, d: str) -> DataFrame:
    """Decisions from a judge's answers."""
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}", i, i + 100, 0.9, f"A{i}", f"B{i}", t) for i, t in enumerate(JUDGED)], "a string, b string, a_ord long, b_ord long, similarity double, a_name string, b_name string, raw string")
    return integrate.decisions(integrate.parsed_judgements(pairs)).select("decision_id", "action", F.array_join("affected_names", "|").alias("names"), "result_node", "confidence", "reason")


#: An answer about a whole chapter, with what is wrong in such answers.
LEGACY = '```json\n{"nodes": [{"id": "k", "name": "A", "category": "定理/定律", "page": 4}, {"name": "B"}, {"id": "z"}, {"id": "y", "name": "C", "category": "?"}, {"id": "x", "name": "D", "definition": null}, {"id": "w", "name": "E", "page": 1.5}, {"id": "v", "name": "F", "page": "9"}], "edges": [{"source": "k", "target": "node_001"}, {"source": "k", "target": "y"}, {"source": "v", "target": "k", "relation_type": "odd"}, {"source": "v", "target": "k", "relation_type": "contains", "description": "d"}, {"source": "k"}]}\n```'


def _legacy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("b", 0, "c", 7, LEGACY), ("b", 1, "c", 7, "no json")], "textbook_id string, batch_no int, chapter string, page int, raw string")


def legacy_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Valid nodes of answers about whole chapters."""
    return records.legacy_nodes(_legacy(spark)).select("id", "name", "definition", "category", "page")


def legacy_edges(spark: SparkSession, d: str) -> DataFrame:
    """Valid edges of answers about whole chapters."""
    return records.legacy_edges(_legacy(spark), records.legacy_nodes(_legacy(spark))).select("source", "target", "relation_type", "description")


#: Answers of the extraction step in all forms they come in.
ANSWERS = [
    '```json\n{"nodes": [{"local_id": "n1", "name": "一个长度超过二十个字的名字会被截断到二十个字为止", "definition": "d", "importance_level": "关键", "page": 3}, {"local_id": "n2", "name": "a", "importance_level": "核心"}, {"local_id": "n3", "name": "a"}], "edges": [{"source": "n1", "target": "n2"}, {"source": "n1", "target": "n9"}]}\n```',
    'text before {"nodes": [{"local_id": "n4", "name": "b", "page": null}, {"local_id": "n5", "definition": "d", "page": "28"}, {"local_id": "n6", "name": null}, {"local_id": "n7", "name": "c", "page": 28.0}, {"local_id": "n8", "name": "c", "page": 28.5}], "edges": [{"source": "n4", "target": "n5", "relation_type": "contains", "description": "x"}, {"source": "n5", "target": "n4", "relation_type": "odd"}]} and after',
    "no json at all", '{"nodes": null}', '{"nodes": [',
]


def _answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("b", i, "c", 7, t) for i, t in enumerate(ANSWERS)], "textbook_id string, batch_no int, chapter string, page int, raw string")


def answer_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Valid nodes of answers with fences, text around, missing, null and fractional fields, and no JSON."""
    return records.parsed_nodes(_answers(spark)).select("batch_no", "local_id", "name", "definition", "importance_level", "page")


def answer_edges(spark: SparkSession, d: str) -> DataFrame:
    """Valid edges of those answers."""
    return records.parsed_edges(_answers(spark)).select("batch_no", "source", "target", "relation_type", "description")


#: A text with numbered statements.
STATED = "定义 1.2 极限是一个数值概念 定理 3 有界数列必有收敛子列 证明 略。定义 1.2 又一次说明极限 引理 4 短 命题　5　任意\n两点之间 若 甲则乙"


def math_items(spark: SparkSession, d: str) -> DataFrame:
    """Numbered statements of a text, the first of each label."""
    return segment.statements(spark.createDataFrame([(1, STATED)], "i int, text string"), ["i"]).drop("i")


_NAMES = (
    rag_topk_dedup, rag_topk_batch, rag_contexts, candidate_pairs, node_pairs, node_dedup, edge_dedup, chunks_600_80, chunks_500_60, batches_4000_200, chunk_index, index_status, batch_pages, markdown_chapters, header_footer_filter,
    heading_numbers, book_ids, char_counts, judge_decisions, kept_nodes_observed, kept_nodes_intent, integration_decisions, budget_trim, integration_stats, integration_stats_observed, merged_edges, domain_coverage, integration_report, graph_union,
    dashboard_totals, dashboard_overview, node_display, decision_stats, llm_json_nodes, llm_json_edges, answer_nodes, answer_edges, legacy_nodes, legacy_edges, judge_answers, resume_pending_books, page_section_asof, outline_tree, tree_counts,
    mind_map, math_statements, math_items, extraction_stats, page_chunk_marks, chapter_ranges, body_font_size, page_marker_strip, ocr_pages, summary_lines,
)
QUERIES = {f.__name__: f for f in _NAMES}
