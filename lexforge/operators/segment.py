"""Documents to chapters, pages to sections, outlines to trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import chapter_number, is_footer, strip, visible_length
from lexforge.operators.prefix import last_known

#: Fixed value: the title of text before the first heading.
PREFACE = "前言"
#: Outline titles that name no chapter.
NO_CHAPTERS = "封面|版权|丛书|前言|目录"


def markdown_chapters(files: DataFrame, first_title: Column | None = None) -> DataFrame:
    """book, ord, title, content, char_count of every chapter of a Markdown text.

    ``files`` has book and content. Headings have one to three signs; a chapter
    comes out if at least one line stands below its heading, or before the first one.
    A text without headings is one chapter; null texts have none.
    """
    start = first_title if first_title is not None else F.lit(PREFACE)
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("t"), F.regexp_extract(x, r"(?U)^#{1,3}\s+(.+)$", 1).alias("h")))
    rows = files.where("content is not null").select("book", start.alias("start"), lines.alias("ls"))
    # headings are places in the array; a chapter is the slice between two of them
    heads = F.filter("ls", lambda s: s["h"] != "")
    cuts = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.col("start").alias("h"))), F.transform(heads, lambda s: F.struct(s["i"].alias("i"), strip(s["h"]).alias("h"))))
    rows = rows.select("book", "ls", cuts.alias("cuts"))
    ends = F.transform("cuts", lambda c, k: F.struct(c["h"].alias("title"), (c["i"] + 1).alias("a"), F.coalesce(F.try_element_at(F.col("cuts"), k + 2)["i"], F.size("ls")).alias("b")))
    parts = rows.select("book", "ls", F.explode(F.filter(ends, lambda c: c["b"] > c["a"])).alias("c"))
    body = F.array_join(F.transform(F.slice("ls", F.col("c.a") + 1, F.col("c.b") - F.col("c.a")), lambda s: s["t"]), "\n")
    out = parts.select("book", F.col("c.a").alias("line_no"), F.col("c.title").alias("title"), body.alias("content"))
    return out.withColumn("char_count", visible_length(F.col("content")))


def body_font_size(page_lines: DataFrame) -> DataFrame:
    """textbook_id and body_size: the upper median size of lines of more than ten characters, 11.0 without any.

    Sizes have one decimal, so a book's sizes are counted and not collected.
    """
    long = F.length(strip(F.col("text"))) > 10
    sizes = page_lines.groupBy("textbook_id", "size").agg(F.count_if(long).alias("n"))
    w = Window.partitionBy("textbook_id").orderBy("size")
    total = F.sum("n").over(Window.partitionBy("textbook_id"))
    ranked = sizes.withColumn("upto", F.sum("n").over(w)).withColumn("total", total)
    return ranked.groupBy("textbook_id").agg(F.coalesce(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("size"))), F.lit(11.0)).alias("body_size"))


def chapter_spans(page_lines: DataFrame, total_pages: DataFrame) -> DataFrame:
    """textbook_id, ord, title, first and last (pages from 0) of chapters found by their headings.

    ``total_pages`` has textbook_id and total_pages, and may have book_title. A page's
    first line with a chapter number that is large, bold or short is a heading. A book
    without headings is one chapter of all pages under the book's title.
    """
    sized = page_lines.join(body_font_size(page_lines), "textbook_id")
    title = strip(F.col("text"))
    heading = chapter_number(F.col("text")).isNotNull() & ((F.col("size") >= 1.15 * F.col("body_size")) | F.col("is_bold") | (F.length(title) < 40))
    heads = sized.where(heading).groupBy("textbook_id", "page_idx").agg(F.min_by(title, "line_idx").alias("title"))
    w = Window.partitionBy("textbook_id").orderBy("page_idx")
    found = heads.join(total_pages.select("textbook_id", "total_pages"), "textbook_id").select("textbook_id", (F.row_number().over(w) - 1).alias("ord"), "title", F.col("page_idx").alias("first"), (F.coalesce(F.lead("page_idx").over(w), F.col("total_pages")) - 1).alias("last"))
    name = F.col("book_title") if "book_title" in total_pages.columns else F.col("textbook_id")
    whole = total_pages.join(heads.select("textbook_id").distinct(), "textbook_id", "left_anti").select("textbook_id", F.lit(0).alias("ord"), name.alias("title"), F.lit(0).alias("first"), (F.col("total_pages") - 1).alias("last"))
    return found.unionByName(whole)


def pdf_chapters(page_lines: DataFrame, total_pages: DataFrame) -> DataFrame:
    """textbook_id, ord, chapter_id, title, page_start, page_end, content, char_count of the chapters of chapter_spans.

    Pages before the first heading are left out, page numbers count from 1. A page's
    chapter is the last one that starts at or before it, so no page is compared with all.
    """
    spans = chapter_spans(page_lines, total_pages)
    body = page_lines.where(~is_footer(F.col("text"))).groupBy("textbook_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), "\n").alias("page"))
    starts = spans.select(F.col("textbook_id").alias("book"), "ord", F.col("first").alias("page"), "title")
    inside = pages_to_sections(body.select(F.col("textbook_id").alias("book"), F.col("page_idx").alias("page"), F.col("page").alias("t")), starts).where("sec_ord is not null")
    texts = inside.groupBy(F.col("book").alias("textbook_id"), F.col("sec_ord").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda s: s["t"]), "\n").alias("content"))
    content = F.coalesce("content", F.lit(""))
    return spans.join(texts, ["textbook_id", "ord"], "left").select("textbook_id", "ord", F.format_string("ch_%02d", F.col("ord") + 1).alias("chapter_id"), "title", (F.col("first") + 1).alias("page_start"), (F.col("last") + 1).alias("page_end"), content.alias("content"), visible_length(content).alias("char_count"))


def outline_tree(toc: DataFrame) -> DataFrame:
    """book, ord, parent_ord, depth, title, page of the kept entries of outlines.

    Levels 1 and 2 are kept, except titles that name no chapter; a level 2 hangs below
    the last level 1 that is kept, and without one it is left out.
    """
    kept = toc.where(F.col("level").isin(1, 2) & ~F.coalesce(F.col("title"), F.lit("")).rlike(NO_CHAPTERS))
    kept = last_known(kept.where("book is not null"), "book", "ord", F.when(F.col("level") == 1, F.col("ord")), to="above")
    tree = kept.where("level = 1 or above is not null")
    return tree.select("book", "ord", F.when(F.col("level") == 2, F.col("above")).alias("parent_ord"), F.col("level").alias("depth"), "title", "page")


def pages_to_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """The pages with sec_ord and sec_title of the last section that starts at or before them; null before the first.

    ``pages`` has book and page, ``sections`` has book, ord, page and title. Both go in
    one order of book and page, cut into ranges of rows, and each page takes the last
    section before it; so a book with many pages or sections goes over many tasks.
    Ties of pages go to the later section; pages of no book or number have no section.
    """
    columns = pages.columns
    row = F.struct(*columns)
    kind = sections.schema["ord"].dataType
    told = sections.where("book is not null and page is not null").select("book", F.struct(F.col("page").cast("long").alias("page"), F.lit(0).alias("k"), F.col("ord").cast("long").alias("n")).alias("_o"), F.to_json(F.struct("ord", "title")).alias("_sec"), F.lit(None).cast(pages.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    asked = pages.where("book is not null and page is not null").select("book", F.struct(F.col("page").cast("long").alias("page"), F.lit(1).alias("k"), F.xxhash64(row).alias("n")).alias("_o"), F.lit(None).cast("string").alias("_sec"), row.alias("_row"))
    placed = last_known(told.unionByName(asked), "book", "_o", F.col("_sec"), to="_last").where("_row is not null")
    sec = F.from_json("_last", f"ord {kind.simpleString()}, title string")
    out = placed.select("_row.*", sec["ord"].alias("sec_ord"), sec["title"].alias("sec_title"))
    rest = pages.where("book is null or page is null").select("*", F.lit(None).cast(kind).alias("sec_ord"), F.lit(None).cast("string").alias("sec_title"))
    return out.unionByName(rest)


def recognised_pages(ocr_lines: DataFrame, least: float = 0.6) -> DataFrame:
    """book, page_idx, text: the lines scored above the bound, joined in order."""
    good = ocr_lines.where(F.col("score") > least)
    return good.groupBy("book", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), "\n").alias("text"))


def full_text(pages: DataFrame) -> DataFrame:
    """book and text: every page behind its mark, in page order."""
    marked = F.concat(F.format_string("[第%d页]\n", F.col("page_idx") + 1), F.col("text"))
    return pages.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", marked.alias("m")))), lambda s: s["m"]), "\n\n").alias("text"))


def section_texts(pages: DataFrame, most: int = 1200, least: int = 50) -> DataFrame:
    """book, sec_ord, text of sections long enough to be summarised."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda s: s["text"]), "\n")
    return pages.where("sec_ord is not null").groupBy("book", "sec_ord").agg(F.substring(joined, 1, most).alias("text")).where(F.length("text") > least)


def summary_lines(answers: DataFrame) -> DataFrame:
    """book, number, summary of lines of the form [N] text; the last line of a number counts."""
    lines = answers.select("book", F.posexplode(F.split("raw", "\n")).alias("line_no", "line"))
    parts = lines.select("book", "line_no", F.regexp_extract(strip(F.col("line")), r"(?U)^\[(\d+)\]\s*(.+)$", 1).try_cast("int").alias("number"), F.regexp_extract(strip(F.col("line")), r"(?U)^\[(\d+)\]\s*(.+)$", 2).alias("summary"))
    return parts.where("number is not null").groupBy("book", "number").agg(F.max_by("summary", "line_no").alias("summary"))


def with_summaries(sections: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sections with their summary by number, empty without one."""
    return sections.join(summaries, ["book", "number"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))


#: Kinds of numbered statements, what ends one, and (in the operator) how a label and its text go together.
STATEMENTS = ["定义", "定理", "命题", "推论", "引理"]
_STOP = r"(?=(?:定义\s*\d|定理\s*\d|命题\s*\d|推论\s*\d|引理\s*\d|例\s*\d|证明|设|则|若|$))"


def statements(texts: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with kind, label and description of every numbered statement; the first of a label counts."""
    found = None
    for n, kind in enumerate(STATEMENTS):
        pattern = rf"(?sU)({kind}\s*\d+(?:\.\d+)?)\s*(.{{5,150}}?){_STOP}"
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("description"))
        part = texts.select(*keep, F.posexplode(pairs).alias("at", "m")).select(*keep, F.lit(n).alias("n"), "at", F.lit(kind).alias("kind"), strip(F.col("m.label")).alias("label"), F.regexp_replace(F.substring(strip(F.col("m.description")), 1, 150), r"(?U)\s+", " ").alias("description"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(*keep, "label").agg(F.min_by(F.struct("kind", "description"), F.struct("n", "at")).alias("s")).select(*keep, "s.kind", "label", "s.description")
