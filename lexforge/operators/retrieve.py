"""Chapters to searchable chunks, and questions to cited contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import chunk_document, citation, page_mark, strip, without_page_marks
from lexforge.operators.chunks import PAGES, RETRIEVAL, Rule, chunk, page_by_share
from lexforge.operators.prefix import last_known
from lexforge.operators.similarity import best_per_key, top_per_question


def build_chunks(chapters: DataFrame, books: DataFrame, rule: Rule = RETRIEVAL) -> DataFrame:
    """chunk_id, textbook_id, ord, chunk_no, text, textbook_name, chapter_title, page_start, page_end.

    ``books`` has textbook_id and title, one row a book. The page of a chunk is its
    share of the chapter's pages.
    """
    texts = chapters.where(strip(F.col("content")) != "")
    keep = ["textbook_id", "ord", "chapter_id", "title", "page_start", "page_end"]
    cut = chunk(texts, "content", rule, keep)
    span = F.greatest(F.col("page_end") - F.col("page_start") + 1, F.lit(1))
    page = page_by_share(F.col("page_start"), F.col("page_end"), F.col("chunk_no"), F.col("n_chunks"), span)
    id_ = F.substring(F.md5(F.concat_ws("_", "textbook_id", "chapter_id", F.col("chunk_no").cast("string")).cast("binary")), 1, 12)
    return cut.join(books.select("textbook_id", F.col("title").alias("textbook_name")), "textbook_id", "left").select(
        id_.alias("chunk_id"), "textbook_id", "ord", "chunk_no", F.col("chunk").alias("text"), "textbook_name", F.col("title").alias("chapter_title"), page.alias("page_start"), "page_end"
    )


def batch_pages(batches: DataFrame) -> DataFrame:
    """Batches with the page at their offset's share of the chapter's length; ``length`` is the chapter's."""
    span = F.col("page_end") - F.col("page_start") + 1
    at = F.col("page_start") + F.floor(F.col("char_offset") / F.greatest("length", F.lit(1)) * span).cast("int")
    return batches.withColumn("page", F.greatest("page_start", F.least(at, F.col("page_end"))))


def answer_contexts(questions: DataFrame, chunks: DataFrame, dim: int, top: int = 5) -> DataFrame:
    """qid, context, citations and source_chunks of the best chunks, one for each chapter, out of twice as many.

    ``chunks`` has ord, text, textbook_name, chapter_title, page_start and embedding.
    """
    keyed = chunks.withColumn("key", F.concat_ws("|", "textbook_name", "chapter_title"))
    found = best_per_key(top_per_question(questions, keyed, dim, 2 * top), top)
    full = found.join(chunks.drop("embedding"), "ord")
    cited = citation(F.col("textbook_name"), F.col("chapter_title"), F.col("page_start"))
    entry = F.struct("place", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), chunk_document(F.col("textbook_name"), F.col("chapter_title"), F.col("page_start"), F.col("text"))).alias("t"), F.col("text").alias("x"), cited.alias("c"), F.round("score", 4).alias("score"))
    got = full.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return got.select("qid", F.array_join(F.transform("x", lambda s: s["t"]), "\n\n---\n\n").alias("context"), F.transform("x", lambda s: F.struct(s["c"].alias("citation"), s["score"].alias("relevance_score"))).alias("citations"), F.transform("x", lambda s: s["x"]).alias("source_chunks"))


def index_status(chunks: DataFrame, model: str = "hashed") -> DataFrame:
    """Books by title, chunks, and the model's name."""
    return chunks.agg(F.countDistinct("textbook_name").alias("indexed_books"), F.count("*").alias("total_chunks")).withColumn("embedding_model", F.lit(model))


def page_chunks(texts: DataFrame, rule: Rule = PAGES, intent: bool = True) -> DataFrame:
    """book, chunk_no, text and page of the chunks of texts with page marks.

    ``texts`` has book and text. The page is that of the first mark in the chunk; a chunk
    without one has page 0 as observed, and with ``intent`` the page of the last mark
    before it.
    """
    cut = chunk(texts.where("text is not null"), "text", rule, ["book"])
    rows = cut.select("book", "chunk_no", F.col("chunk").alias("text"), page_mark(F.col("chunk")).alias("page"))
    if not intent:
        return rows
    last = F.regexp_extract_all("text", F.lit(r"(?U)\[第(\d+)页\]"), F.lit(1))
    marked = F.when(F.col("page") > 0, F.element_at(last, -1).try_cast("int"))
    told = last_known(rows, "book", "chunk_no", marked, to="_at")
    return told.select("book", "chunk_no", "text", F.when(F.col("page") > 0, F.col("page")).otherwise(F.coalesce("_at", F.lit(0))).alias("page"))


def page_contexts(questions: DataFrame, chunks: DataFrame, dim: int, top: int = 5) -> DataFrame:
    """qid, context and pages of the best chunks, one for each page, out of twice as many.

    ``chunks`` has ord, text, page and embedding.
    """
    keyed = chunks.withColumn("key", F.col("page"))
    found = best_per_key(top_per_question(questions, keyed, dim, 2 * top), top)
    full = found.join(chunks.select("ord", "text", "page"), "ord")
    entry = F.concat(F.lit("["), F.col("place").cast("string"), F.format_string("] (第%d页)\n", "page"), without_page_marks(F.col("text")))
    got = full.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("t"), "page", F.round("score", 4).alias("score")))).alias("x"))
    return got.select("qid", F.array_join(F.transform("x", lambda s: s["t"]), "\n\n---\n\n").alias("context"), F.transform("x", lambda s: F.struct(s["place"].alias("idx"), s["page"].alias("page"), s["score"].alias("score"))).alias("citations"))
