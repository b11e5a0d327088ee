"""Files to textbooks and chapters."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions.text import book_id, book_title, strip, visible_length
from lexforge.operators.segment import markdown_chapters, pdf_chapters
from lexforge.schemas import schema
from lexforge.session import ship
from lexforge.sources import pdf as _pdf

#: Suffixes that can be parsed, and those that a folder scan takes.
PARSED, SCANNED = (".pdf", ".md", ".txt", ".markdown", ".docx", ".xlsx"), (".pdf", ".md", ".txt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def list_files(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """path, filename, suffix and content of the files that a scan takes, in order of path."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).alias("suffix"), "content").where(F.col("suffix").isin(*SCANNED))
    return out.orderBy("path").limit(first) if first is not None else out


def docx_paragraphs(content: bytes) -> list[tuple[int, str, str]]:
    """Order, style name and text of the paragraphs that aren't blank; tables are left out.

    A paragraph names its style by id; the name is in the table of styles, and without
    one the id stands for it. Paragraphs without a style have the default one.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    names, usual = {}, ""
    for s in styles.iter(f"{_W}style") if styles is not None else []:
        name = s.find(f"{_W}name")
        names[s.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "") if name is not None else ""
        if s.get(f"{_W}type") == "paragraph" and s.get(f"{_W}default") in ("1", "true"):
            usual = names[s.get(f"{_W}styleId", "")]
    body, out = root.find(f"{_W}body"), []
    for p in body.findall(f"{_W}p") if body is not None else []:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
        text = "".join(parts[e.tag](e) for r in p.iter(f"{_W}r") for e in r if e.tag in parts).strip()
        if text:
            key = style.get(f"{_W}val", "") if style is not None else None
            out.append((len(out), usual if key is None else names.get(key, key), text))
    return out


def _column(ref: str) -> int:
    """The number from 0 of a cell's column by its name, such as AB12."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def xlsx_rows(content: bytes) -> list[tuple[int, str, int, list[str]]]:
    """Place and name of the sheet, row number and cells as text; every sheet has a row, -1 if it is empty.

    Sheets are found by the links of the workbook, cells by the names of their columns,
    so sheets in another order and missing cells come out right.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        links = {}
        if "xl/_rels/workbook.xml.rels" in names:
            links = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target", ""))).lstrip("/") if not r.get("Target", "").startswith("/") else r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")):
            path = links.get(sheet.get(_R), f"xl/worksheets/sheet{n + 1}.xml")
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row") if path in names else []:
                cells: dict[int, str] = {}
                for k, c in enumerate(row.findall(f"{_S}c")):
                    value = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                    at = _column(c.get("r")) if c.get("r") else k
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                # rows that are left out are empty
                while row.get("r") and len(rows) < int(row.get("r")) - 1 and rows:
                    rows.append([])
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            wide = max((len(r) for r in rows), default=0)
            out += [(n, sheet.get("name", ""), r, cells + [""] * (wide - len(cells))) for r, cells in enumerate(rows)] or [(n, sheet.get("name", ""), -1, [])]
    return out


def _unpack(files: DataFrame, each: Callable[[bytes], list], fields: str, names: list[str]) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *r) for f, c in zip(batch["filename"], batch["content"], strict=True) for r in each(bytes(c))]
            yield pd.DataFrame(rows, columns=["filename", *names])

    return files.select("filename", "content").mapInPandas(run, f"filename string, {fields}")


def docx_chapters(files: DataFrame) -> DataFrame:
    """filename, ord, title, content: headings are paragraphs of a heading style; text before them stands under the book's title.

    A heading without text below it vanishes; a file without any text is one empty chapter.
    """
    docs = files.where("suffix = '.docx'")
    p = _unpack(docs, docx_paragraphs, "ord int, style string, text string", ["ord", "style", "text"])
    heading = F.col("style").rlike("^[Hh]eading|标题")
    struct = F.struct("ord", heading.alias("h"), "text")
    books = p.groupBy("filename").agg(F.array_sort(F.collect_list(struct)).alias("ps"))
    # a chapter is the slice between two headings
    heads = F.concat(F.array(F.struct(F.lit(-1).alias("i"), book_title(F.col("filename")).alias("t"))), F.filter(F.transform("ps", lambda x, i: F.when(x["h"], F.struct(i.alias("i"), x["text"].alias("t")))), lambda x: x.isNotNull()))
    books = books.select("filename", "ps", heads.alias("heads"))
    spans = F.transform("heads", lambda x, k: F.struct(x["t"].alias("title"), x["i"].alias("at"), (F.coalesce(F.try_element_at(F.col("heads"), k + 2)["i"], F.size("ps")) - x["i"] - 1).alias("n")))
    parts = books.select("filename", "ps", F.explode(F.filter(spans, lambda x: x["n"] > 0)).alias("c"))
    body = F.array_join(F.transform(F.slice("ps", F.col("c.at") + 2, F.col("c.n")), lambda x: x["text"]), "\n")
    found = parts.select("filename", F.col("c.at").alias("ord"), F.col("c.title").alias("title"), body.alias("content"))
    # without text below any heading the headings are the text
    bare = F.array_join(F.transform("ps", lambda x: x["text"]), "\n")
    titles = books.where(F.size(F.filter(spans, lambda x: x["n"] > 0)) == 0).select("filename", F.lit(0).alias("ord"), book_title(F.col("filename")).alias("title"), bare.alias("content"))
    empty = docs.select("filename").join(p.select("filename").distinct(), "filename", "left_anti").select("filename", F.lit(0).alias("ord"), book_title(F.col("filename")).alias("title"), F.lit("").alias("content"))
    return found.unionByName(titles).unionByName(empty)


def xlsx_chapters(files: DataFrame) -> DataFrame:
    """filename, ord, title, content of every sheet with rows below its header, in the order of sheets: the header, then the rows with their filled cells.

    A header cell without text is called by its place, and a name that repeats is
    numbered. If no sheet has rows, all of them are one chapter of plain rows.
    """
    rows = _unpack(files.where("suffix = '.xlsx'"), xlsx_rows, "ord int, sheet string, row_idx int, cells array<string>", ["ord", "sheet", "row_idx", "cells"])
    named = F.transform("cells", lambda c, i: F.when(c == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(c))
    before = lambda i: F.size(F.filter(F.slice(F.col("named"), 1, i), lambda x: x == F.element_at("named", i + 1)))
    header = F.transform("named", lambda c, i: F.when(before(i) > 0, F.concat(c, F.lit("."), before(i).cast("string"))).otherwise(c))
    rows = rows.withColumn("named", named).withColumn("header", header)
    filled = F.filter("cells", lambda c: ~c.isin("nan", "None", ""))
    line = F.when(F.col("row_idx") == 0, F.array_join("header", ", ")).otherwise(F.array_join(filled, " | "))
    per = rows.withColumn("line", line).groupBy("filename", "ord", "sheet").agg(F.max("row_idx").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("row_idx") == 0) | (F.col("line") != ""), F.struct("row_idx", "line")))), lambda s: s["line"]), "\n").alias("content"))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    full = per.where("last >= 1").select("filename", "ord", F.concat(stem, F.lit(" - "), "sheet").alias("title"), "content")
    # the plain form of a sheet ends in a line end, that of an empty one is a line end only
    plain = F.concat(F.when(F.col("last") < 0, F.lit("")).otherwise(F.regexp_replace("content", ", ", ",")), F.lit("\n"))
    empty = per.join(full.select("filename").distinct(), "filename", "left_anti").groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", plain.alias("t")))), lambda s: s["t"]), "\n").alias("content"))
    return full.unionByName(empty.select("filename", F.lit(0).alias("ord"), stem.alias("title"), "content"))


def text_chapters(files: DataFrame) -> DataFrame:
    """filename, ord, title, content of Markdown and plain text files."""
    read = files.withColumn("text", F.decode("content", "UTF-8"))
    md = markdown_chapters(read.where(F.col("suffix").isin(".md", ".markdown")).select(F.col("filename").alias("book"), F.col("text").alias("content")))
    plain = read.where("suffix = '.txt'").select("filename", F.lit(0).alias("ord"), book_title(F.col("filename")).alias("title"), F.col("text").alias("content"))
    return md.select(F.col("book").alias("filename"), F.col("line_no").alias("ord"), "title", "content").unionByName(plain)


def _or_error(read: Callable[[bytes], list], width: int) -> Callable[[bytes], list]:
    """The rows of a file with no error, or one row of nothing with the error."""

    def run(content: bytes) -> list:
        try:
            return [(*r, None) for r in read(content)]
        except Exception as e:  # noqa: BLE001 - any file may be broken in any way
            return [(*[None] * width, f"{type(e).__name__}: {e}")]

    return run


def pdf_scan(files: DataFrame) -> DataFrame:
    """filename, page_idx, line_idx, text, size, is_bold, y and error: the lines of PDF files, or why a file can't be read."""
    names = ["page_idx", "line_idx", "text", "size", "is_bold", "y", "error"]
    return _unpack(files.where("suffix = '.pdf'"), _or_error(_pdf.page_lines, 6), "page_idx int, line_idx int, text string, size double, is_bold boolean, y double, error string", names)


def pdf_outline(files: DataFrame) -> DataFrame:
    """book (the name without its suffix), ord, level, title and page of the entries of the outlines of PDF files."""
    read = lambda content: [(k, *e) for k, e in enumerate(_pdf.outline(content))]
    rows = _unpack(files.where("suffix = '.pdf'"), _or_error(read, 4), "ord int, level int, title string, page int, error string", ["ord", "level", "title", "page", "error"])
    return rows.where("error is null").select(F.regexp_replace("filename", r"\.[^.]*$", "").alias("book"), "ord", "level", strip(F.col("title")).alias("title"), "page")


def pdf_pages(files: DataFrame) -> DataFrame:
    """filename, total_pages and error of PDF files."""
    count = lambda content: [(_pdf.page_count(content),)]
    return _unpack(files.where("suffix = '.pdf'"), _or_error(count, 1), "total_pages int, error string", ["total_pages", "error"])


def read_pdf(files: DataFrame) -> DataFrame:
    """filename, ord, title, content, page_start, page_end of the chapters of PDF files that can be read."""
    pages = pdf_pages(files).where("error is null").select(F.col("filename").alias("textbook_id"), "total_pages", book_title(F.col("filename")).alias("book_title"))
    lines = pdf_scan(files).where("error is null").select(F.col("filename").alias("textbook_id"), "page_idx", "line_idx", "text", "size", "is_bold")
    out = pdf_chapters(lines, pages)
    return out.select(F.col("textbook_id").alias("filename"), "ord", "title", "content", "page_start", "page_end")


def read_chapters(files: DataFrame, pdf: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """textbook_id, filename, chapter_id, title, page_start, page_end, content, char_count and error of all files that can be parsed.

    ``pdf`` turns PDF files into rows of filename, ord, title and content instead of the
    reader of this package. No file is lost: one without any chapter, such as a PDF that
    can't be read, is a row without chapter_id and content whose error says why.
    """
    bad = files.where(~F.col("suffix").isin(*PARSED)).select("filename").limit(1).collect()
    if bad:
        raise ValueError(f"no reader for {bad[0].filename}")
    one = F.lit(1).alias("page_start"), F.lit(1).alias("page_end")
    out = text_chapters(files).unionByName(docx_chapters(files)).unionByName(xlsx_chapters(files)).select("*", *one)
    pdfs = files.where("suffix = '.pdf'")
    made = pdf(pdfs) if pdf else read_pdf(pdfs)
    out = out.unionByName(made if "page_start" in made.columns else made.select("*", *one))
    n = F.row_number().over(Window.partitionBy("filename").orderBy("ord", "title"))
    found = out.select(book_id(F.col("filename")).alias("textbook_id"), "filename", F.format_string("ch_%02d", n).alias("chapter_id"), "title", "page_start", "page_end", "content", visible_length(F.col("content")).alias("char_count"), F.lit(None).cast("string").alias("error"))
    why = pdf_pages(files).select("filename", "error") if not pdf else pdfs.select("filename", F.lit(None).cast("string").alias("error"))
    lost = files.select("filename").join(out.select("filename").distinct(), "filename", "left_anti").join(why, "filename", "left")
    none = lambda t: F.lit(None).cast(t)
    return found.unionByName(lost.select(book_id(F.col("filename")).alias("textbook_id"), "filename", none("string").alias("chapter_id"), book_title(F.col("filename")).alias("title"), none("int").alias("page_start"), none("int").alias("page_end"), none("string").alias("content"), F.lit(0).alias("char_count"), F.coalesce("error", F.lit("no chapter")).alias("error")))


def read_books(chapters: DataFrame) -> DataFrame:
    """textbook_id, filename, title, total_pages, total_chars of the books of read_chapters; a text file has one page."""
    return chapters.groupBy("textbook_id", "filename").agg(book_title(F.first("filename")).alias("title"), F.coalesce(F.max("page_end"), F.lit(0)).alias("total_pages"), F.sum("char_count").alias("total_chars"))


def read_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Records of an exported file by their schema; an empty table if the file is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema(table))
    return spark.read.schema(schema(table)).json(path, multiLine=True)
