"""The engine's operators put together: files to chapters, chapters to graphs, graphs to one graph, questions to answers."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge import plugins
from lexforge.functions.text import embedding_text, strip
from lexforge.operators import chunks as _chunks
from lexforge.operators import integrate as _integrate
from lexforge.operators import records, retrieve, segment
from lexforge.operators.prefix import running
from lexforge.operators.similarity import candidate_pairs
from lexforge.session import keep

#: What models are told to do.
EXTRACT = "你从教材片段中抽取知识点和它们的关系，只输出一个 JSON 对象：nodes 的每项有 local_id、name（至多 20 字）、definition、importance_level（关键、重要或补充）、page；edges 的每项有 source、target（local_id）、relation_type（prerequisite、parallel、contains 或 applies_to）、description。"
WHOLE = "你从教材的一章中抽取知识图谱，只输出一个 JSON 对象：nodes 的每项有 id、name、definition、category（核心概念、定理/定律、方法/技术或现象/过程）、page；edges 的每项有 source、target、relation_type、description。"
STRICT = "上次的输出不是合法的 JSON。只输出一个 JSON 对象，不要代码围栏，不要其他文字。\n\n"
JUDGE = "你判断来自不同教材的两个知识点是否同一概念，只输出一个 JSON 对象：is_same、confidence（0 到 1）、action（merge、keep 或 remove）、best_source（a 或 b）、reason。没有把握时保留两者。"
ANSWER = "你只根据给出的参考资料回答问题，每个要点后注明来源 [教材, 章节, 页]，资料不足时直说，用中文简要作答。"
PAGES = "你只根据给出的参考资料回答问题，公式用 LaTeX，每个要点后注明 [第X页]，资料不足时直说。"
SUMMARISE = "对每个编号的章节用一句中文总结核心内容，每行写作 [编号] 总结，不写其他内容。"
#: Answers where there is nothing to answer from (fixed values of the offline contract).
NO_INDEX = "尚未构建索引。请先上传教材并完成解析和索引构建。"


@dataclass(frozen=True)
class Extraction:
    """nodes and edges of all books, one row of stats a book, and the answers they were read from."""

    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame
    answers: DataFrame


def _make(answer: Callable) -> Callable:
    return lambda: answer


def extraction_batches(chapters: DataFrame, books: DataFrame, max_batches: int = 0) -> DataFrame:
    """textbook_id, batch_no (from 0 over the book), chapter, page and prompt of every piece of text that is asked about.

    ``chapters`` has textbook_id, ord, title, content, page_start and page_end; blank ones
    have no batches. With ``max_batches`` only so many first ones of each book are asked.
    """
    rows = chapters.where(strip(F.col("content")) != "").withColumn("length", F.length("content"))
    cut = _chunks.chunk(rows, "content", _chunks.BATCHES, ["textbook_id", "ord", "title", "page_start", "page_end", "length"])
    placed = running(retrieve.batch_pages(cut), [F.col("textbook_id"), F.col("ord"), F.col("chunk_no")], F.lit(0), to="_z", number="n")
    first = placed.groupBy("textbook_id").agg(F.min("n").alias("first"))
    named = placed.join(first, "textbook_id").join(books.select("textbook_id", F.col("title").alias("book")), "textbook_id", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    prompt = F.concat(F.lit("教材："), blank(F.col("book")), F.lit("\n章节："), blank(F.col("title")), F.lit("\n起始页码："), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("\n文本：\n"), "chunk")
    out = named.select("textbook_id", (F.col("n") - F.col("first")).cast("int").alias("batch_no"), F.col("title").alias("chapter"), "page", prompt.alias("prompt"))
    return out.where(F.col("batch_no") < max_batches) if max_batches > 0 else out


def extract(chapters: DataFrame, books: DataFrame, model: Callable[[], plugins.Model] | None = None, max_batches: int = 0, **options) -> Extraction:
    """Graphs of all books by asking a model about every batch once.

    A batch whose tries all failed counts as a batch and has no nodes. Nodes are numbered
    over the book, names that repeat are merged, and edges point at the nodes that stay.
    """
    asked = plugins.ask(extraction_batches(chapters, books, max_batches), "prompt", model or _make(plugins.no_extraction), system=EXTRACT, **options)
    answers = keep(asked.select("textbook_id", "batch_no", "chapter", "page", "raw", "raw_error"))
    numbered = keep(records.numbered(records.parsed_nodes(answers)))
    edges = records.resolved_edges(records.parsed_edges(answers), numbered)
    ordered = running(edges, [F.col("textbook_id"), F.col("batch_no"), F.col("pos"), F.col("source"), F.col("target")], F.lit(0), to="_z", number="ord").drop("_z")
    per = answers.groupBy("textbook_id").agg(F.count("*").alias("batch_count"), F.count("raw_error").alias("failed_batches"), F.coalesce(F.sum(F.floor(F.length("raw") / 2)), F.lit(0)).alias("total_cost_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    stats = books.select("textbook_id").distinct().join(per, "textbook_id", "left").select("textbook_id", zero("batch_count"), zero("failed_batches"), zero("total_cost_tokens"))
    return Extraction(records.deduplicated_nodes(numbered), records.deduplicated_edges(ordered, ["textbook_id"]), stats, answers)


def extract_whole(chapters: DataFrame, books: DataFrame, model: Callable[[], plugins.Model] | None = None, most: int = 6000, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges by asking about each chapter's first characters at once; an answer that is no JSON is asked for once more, more strictly."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = chapters.where(strip(F.col("content")) != "").join(books.select("textbook_id", F.col("title").alias("book")), "textbook_id", "left")
    prompt = F.concat(F.lit("教材："), F.coalesce("book", "textbook_id"), F.lit("\n章节："), blank("title"), F.lit("\n起始页码："), F.coalesce(F.col("page_start").cast("string"), F.lit("")), F.lit("\n\n"), F.substring("content", 1, most))
    rows = named.select("textbook_id", F.col("ord").alias("batch_no"), F.col("title").alias("chapter"), F.col("page_start").alias("page"), prompt.alias("prompt"))
    make = model or _make(plugins.no_extraction)
    first = keep(plugins.ask(rows, "prompt", make, system=WHOLE, **options).withColumn("ok", records.is_answer(F.col("raw"))))
    again = plugins.ask(first.where("not coalesce(ok, false)").withColumn("prompt", F.concat(F.lit(STRICT), "prompt")).drop("raw", "raw_error", "ok"), "prompt", make, system=WHOLE, **options)
    columns = ["textbook_id", "batch_no", "chapter", "page", "raw"]
    answers = keep(first.where("ok").select(*columns).unionByName(again.select(*columns)))
    nodes = records.legacy_nodes(answers)
    return nodes, records.legacy_edges(answers, nodes)


@dataclass(frozen=True)
class Integration:
    """All decisions, the nodes and edges of the merged graph, one row of stats, and the report."""

    decisions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame
    report: DataFrame


def integrate(nodes: DataFrame, edges: DataFrame, dim: int, judge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, model: Callable[[], plugins.Model] | None = None, encoder: Callable | None = None, least: float = 0.70, intent: bool = True, generated_at: str | None = None, **options) -> Integration:
    """Concepts of several books to one graph below the budget.

    ``nodes`` has id, name, definition, importance_level, textbook_id, chapter, page and
    ord, and embedding unless an ``encoder`` is to make it. A pair is judged by ``judge``
    (pairs and nodes to judgements), or by asking a ``model``; without either every pair
    is kept, as the offline contract says.
    """
    if encoder is not None or "embedding" not in nodes.columns:
        told = nodes.withColumn("_text", embedding_text(F.coalesce("name", F.lit("")), F.coalesce("definition", F.lit(""))))
        nodes = plugins.embed(told, "_text", encoder).drop("_text")
    nodes = keep(nodes)
    pairs = candidate_pairs(nodes.select("id", F.col("textbook_id").alias("book"), "ord", "embedding"), dim, least)
    if judge is not None:
        judged = judge(pairs, nodes)
    else:
        judged = _integrate.parsed_judgements(keep(plugins.ask(_integrate.judge_prompts(pairs, nodes), "prompt", model or _make(plugins.no_merge), system=JUDGE, **options)))
    decided = keep(_integrate.decisions(judged))
    final, more = _integrate.budget(_integrate.kept_nodes(nodes, decided, intent), _integrate.original_chars(nodes), decided.count())
    final, every = keep(final), keep(decided.unionByName(more))
    stat = keep(_integrate.stats(nodes, final, every, intent))
    report = _integrate.report(stat, _integrate.domain_coverage(final), every, _integrate.completeness(nodes, final, every), generated_at=generated_at)
    return Integration(every, final, _integrate.merged_edges(edges, every, final), stat, report)


def build_index(chapters: DataFrame, books: DataFrame, encoder: Callable | None = None, key: str | None = None) -> DataFrame:
    """The chunks of retrieve.build_chunks with ord and their vectors, written once."""
    made = retrieve.build_chunks(chapters, books)
    placed = running(made, [F.col("textbook_id"), F.col("ord"), F.col("chunk_no")], F.lit(0), to="_z", number="n").drop("_z", "ord").withColumnRenamed("n", "ord")
    return keep(plugins.embed(placed, "text", encoder, key=key))


def answer(questions: DataFrame, index: DataFrame, dim: int, model: Callable[[], plugins.Model] | None = None, encoder: Callable | None = None, top: int = 5, **options) -> DataFrame:
    """qid, answer, citations and source_chunks of every question.

    ``questions`` has qid and question. Without an index the answer says so.
    """
    if index.isEmpty():
        empty = F.array().cast("array<struct<citation: string, relevance_score: double>>")
        return questions.select("qid", F.lit(NO_INDEX).alias("answer"), empty.alias("citations"), F.array().cast("array<string>").alias("source_chunks"))
    asked = keep(plugins.embed(questions.select("qid", "question"), "question", encoder))
    found = retrieve.answer_contexts(asked, index.select("ord", "text", F.coalesce("textbook_name", F.lit("")).alias("textbook_name"), F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), F.coalesce("page_start", F.lit(0)).alias("page_start"), "embedding"), dim, top)
    prompt = F.concat(F.lit("参考资料：\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\n问题："), F.coalesce("question", F.lit("")))
    rows = asked.select("qid", "question").join(found, "qid", "left").withColumn("prompt", prompt)
    return plugins.ask(rows, "prompt", model or _make(plugins.no_answer), to="answer", system=ANSWER, **options).select("qid", "answer", "citations", "source_chunks")


def page_answers(questions: DataFrame, chunks: DataFrame, dim: int, model: Callable[[], plugins.Model] | None = None, encoder: Callable | None = None, top: int = 5, **options) -> DataFrame:
    """qid, answer and citations by page; where the model fails, the answer is the error and the start of what was found."""
    asked = keep(plugins.embed(questions.select("qid", "question"), "question", encoder))
    found = retrieve.page_contexts(asked, chunks, dim, top)
    rows = keep(plugins.ask(asked.select("qid", "question").join(found, "qid").withColumn("prompt", F.concat(F.lit("参考资料：\n\n"), "context", F.lit("\n\n问题："), F.coalesce("question", F.lit("")))), "prompt", model or _make(plugins.no_answer), to="answer", system=PAGES, **options))
    failed = F.concat(F.lit("模型调用失败: "), F.coalesce("answer_error", F.lit("")), F.lit("\n\n检索到的相关资料:\n"), F.substring("context", 1, 1500))
    told = rows.select("qid", F.when(F.col("answer_error").isNotNull(), failed).otherwise(F.col("answer")).alias("answer"), "citations")
    nothing = questions.select("qid").join(told.select("qid"), "qid", "left_anti").select("qid", F.lit("未找到相关内容").alias("answer"), F.array().cast(told.schema["citations"].dataType).alias("citations"))
    return told.unionByName(nothing)


def mind_map(toc: DataFrame) -> DataFrame:
    """book, node_id, parent_id, path, depth, name, page and type: the book, its chapters and their sections.

    ``toc`` has book, ord, level, title and page; the book itself is the root, also of an
    outline without chapters.
    """
    kept = segment.outline_tree(toc)
    node = lambda c: F.concat("book", F.lit("/"), F.col(c).cast("string"))
    root = toc.where("book is not null").select("book").distinct().select("book", F.col("book").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<bigint>").alias("path"), F.lit(0).alias("depth"), F.col("book").alias("name"), F.lit(None).cast("int").alias("page"))
    path = F.when(F.col("depth") == 1, F.array(F.col("ord").cast("long"))).otherwise(F.array(F.col("parent_ord").cast("long"), F.col("ord").cast("long")))
    below = kept.select("book", node("ord").alias("node_id"), F.when(F.col("depth") == 1, F.col("book")).otherwise(node("parent_ord")).alias("parent_id"), path.alias("path"), "depth", strip(F.col("title")).alias("name"), "page")
    return root.unionByName(below).withColumn("type", F.lit(None).cast("string"))


def section_pages(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Recognised pages (book, page_idx from 0, text) with the ord and title of the section they lie in; pages without text or section are left out."""
    sections = segment.outline_tree(toc).where("depth = 2").select("book", "ord", "page", "title")
    placed = segment.pages_to_sections(pages.where(strip(F.col("text")) != "").select("book", (F.col("page_idx") + 1).alias("page"), "page_idx", "text"), sections)
    return placed.where("sec_ord is not null").select("book", "page_idx", "text", "sec_ord")


def summaries(texts: DataFrame, model: Callable[[], plugins.Model] | None = None, **options) -> DataFrame:
    """book, sec_ord and summary: one question a book about all its sections; a section that isn't answered has an empty one.

    ``texts`` has book, sec_ord and text. Without a model, or where it fails, all are empty.
    """
    title = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 40)
    numbered = keep(texts.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("sec_ord", F.concat(title, F.lit("\n"), F.substring("text", 1, 800)).alias("t")))).alias("s")).select("book", F.posexplode("s").alias("number", "x")).select("book", "number", "x.sec_ord", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), "x.t").alias("t")))
    prompt = numbered.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "t"))), lambda x: x["t"]), "\n\n").alias("prompt"))
    told = segment.summary_lines(keep(plugins.ask(prompt, "prompt", model or _make(lambda messages: ""), system=SUMMARISE, **options)).select("book", F.coalesce("raw", F.lit("")).alias("raw")))
    return segment.with_summaries(numbered.select("book", "number", "sec_ord"), told).select("book", "sec_ord", "summary")


def enriched_tree(toc: DataFrame, pages: DataFrame, model: Callable[[], plugins.Model] | None = None, **options) -> DataFrame:
    """The rows of mind_map with a summary below every section that has enough recognised text and an answer."""
    tree = mind_map(toc)
    texts = segment.section_texts(section_pages(toc, pages))
    said = summaries(texts, model, **options).where(strip(F.col("summary")) != "")
    at = tree.where("depth = 2").select("book", F.try_element_at("path", F.lit(-1)).alias("sec_ord"), F.col("node_id").alias("parent_id"), "path")
    items = said.withColumn("sec_ord", F.col("sec_ord").cast("long")).join(at, ["book", "sec_ord"]).select("book", F.concat("parent_id", F.lit("/s")).alias("node_id"), "parent_id", F.concat("path", F.array(F.lit(0).cast("long"))).alias("path"), F.lit(3).alias("depth"), F.substring(strip(F.col("summary")), 1, 120).alias("name"), F.lit(None).cast("int").alias("page"), F.lit("总结").alias("type"))
    return tree.unionByName(items)


def answers_of(known: dict[str, str], otherwise: str = "") -> Callable[[], plugins.Model]:
    """A model that answers from a table of prompts, for tests and replays."""
    table = json.dumps(known, ensure_ascii=False)
    return lambda: (lambda messages, _t=json.loads(table): _t.get(messages[-1]["content"], otherwise))
