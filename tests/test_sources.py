import io
import json
import zipfile

from conftest import by_hand
from pyspark.sql import functions as F

from lexforge import plugins
from lexforge.sources import readers, sinks
from lexforge.streaming.incremental import pending, run_new


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def xlsx(rows):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{data}</sheetData></worksheet>")
    return out.getvalue()


def test_all_kinds_of_files(spark, tmp_path):
    (tmp_path / "01_a.md").write_text("x\n# T\ny", encoding="utf-8")
    (tmp_path / "b.TXT").write_text("plain", encoding="utf-8")
    (tmp_path / "c.docx").write_bytes(docx([("", "before"), ("Heading1", "H"), ("", "after"), ("", "  ")]))
    (tmp_path / "d.xlsx").write_bytes(xlsx([["h1", "h2"], ["1", "nan"], ["", ""]]))
    listed = readers.list_files(spark, str(tmp_path))
    assert [r.filename for r in listed.collect()] == ["01_a.md", "b.TXT"]
    assert readers.list_files(spark, str(tmp_path), first=1).count() == 1
    files = spark.read.format("binaryFile").load(str(tmp_path))
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).alias("suffix"), "content")
    got = by_hand(readers.read_chapters(files).select("filename", "title", "content"))
    assert got == [("01_a.md", "T", "y"), ("01_a.md", "前言", "x"), ("b.TXT", "b", "plain"), ("c.docx", "H", "after"), ("c.docx", "c", "before"), ("d.xlsx", "d - S1", "h1, h2\n1")]


def test_unknown_suffix_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="x.exe"):
        readers.read_chapters(spark.createDataFrame([("x.exe", ".exe", b"")], "filename string, suffix string, content binary"))


def test_json_both_ways(spark, tmp_path):
    assert readers.read_json(spark, str(tmp_path / "none.json"), "edges").count() == 0
    (tmp_path / "e.json").write_text(json.dumps([{"source": "a", "target": "b"}]))
    assert readers.read_json(spark, str(tmp_path / "e.json"), "edges").first().target == "b"
    sinks.export_json(spark.createDataFrame([(1,)], "i int"), str(tmp_path / "out"))
    sinks.export_text(spark.createDataFrame([("# r",)], "t string"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == "# r"


def test_incremental_runs_go_on_where_they_stopped(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    one = lambda b: spark.createDataFrame([(b, "f", b, 1, 2)], "textbook_id string, filename string, title string, total_pages int, total_chars long")
    one("b1").coalesce(1).write.mode("append").parquet(source)
    run_new(spark, source, "textbooks", lambda df: df.withColumn("n", F.lit(1)), out, cp)
    one("b2").coalesce(1).write.mode("append").parquet(source)
    run_new(spark, source, "textbooks", lambda df: df.withColumn("n", F.lit(2)), out, cp)
    assert by_hand(spark.read.parquet(out).select("textbook_id", "n")) == [("b1", 1), ("b2", 2)]
    assert by_hand(pending(spark.createDataFrame([("b1",), ("b3",)], "textbook_id string"), spark.read.parquet(out))) == [("b3",)]


def test_incremental_keeps_a_book_that_arrives_in_two_batches(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for title in ("first", "second", "third"):
        spark.createDataFrame([("b1", "f", title, 1, 2)], "textbook_id string, filename string, title string, total_pages int, total_chars long").coalesce(1).write.mode("append").parquet(source)
        run_new(spark, source, "textbooks", lambda df: df, out, cp)
    assert by_hand(spark.read.parquet(out).select("textbook_id", "title")) == [("b1", "first"), ("b1", "second"), ("b1", "third")]


def test_plugins(spark):
    rows = spark.createDataFrame([("极限",), (None,)], "t string")
    got = [r.embedding for r in plugins.embed(rows, "t").collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-5 and sum(map(abs, got[1])) == 0

    def flaky():
        calls = []

        def model(messages):
            calls.append(1)
            if len(calls) < 3:
                raise OSError("net")
            return "ok " + messages[0]["content"]

        return model

    asked = plugins.ask(rows.where("t is not null"), "t", flaky).first()
    assert asked.raw == "ok 极限" and asked.raw_error is None
    failed = plugins.ask(rows.where("t is not null"), "t", flaky, tries=1).first()
    assert failed.raw is None and failed.raw_error == "net"
    assert json.loads(plugins.no_extraction([])) == {"nodes": [], "edges": []}


def listed(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).alias("suffix"), "content")


def test_docx_styles_are_known_by_name(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = [("1", "heading 1", ""), ("a", "Normal", ' w:default="1"'), ("2", "我的标题", ""), ("x", "Heading-like", "")]
    body = [("1", "# One"), ("", "# text"), ("2", "Two"), ("x", "Three"), ("a", "end")]
    with zipfile.ZipFile(tmp_path / "02_s.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>" + "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in body) + "</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>" + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"{d}><w:name w:val="{n}"/></w:style>' for i, n, d in styles) + "</w:styles>")
    (tmp_path / "e.docx").write_bytes(docx([("Heading1", "only"), ("heading 2", "these")]))
    (tmp_path / "f.docx").write_bytes(docx([]))
    got = by_hand(readers.read_chapters(listed(spark, tmp_path)).select("filename", "chapter_id", "title", "content"))
    assert got == [("02_s.docx", "ch_01", "# One", "# text"), ("02_s.docx", "ch_02", "Three", "end"), ("e.docx", "ch_01", "e", "only\nthese"), ("f.docx", "ch_01", "f", "")]


def book(sheets, order=None):
    """A workbook; ``order`` has the file of each sheet. Cells are (name, text)."""
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        files = order or list(range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{f}.xml"/>' for k, f in enumerate(files)) + "</Relationships>")
        for (_, rows), f in zip(sheets, files, strict=True):
            data = "".join(f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in row) + "</row>" for n, row in rows)
            z.writestr(f"xl/worksheets/sheet{f}.xml", f'<worksheet xmlns="{s}"><sheetData>{data}</sheetData></worksheet>')
    return out.getvalue()


def test_xlsx_sheets_by_link_and_cells_by_column(spark, tmp_path):
    two = [("Z", [(1, [("A", "h"), ("C", "h"), ("D", "k")]), (2, [("C", "x")]), (4, [("A", "1"), ("D", "None")])]), ("A", [(1, [("A", "p")]), (2, [("A", "q")])]), ("none", [])]
    (tmp_path / "01_t.xlsx").write_bytes(book(two, [2, 1, 3]))
    (tmp_path / "u.xlsx").write_bytes(book([("S", [(1, [("A", "only"), ("B", "head")])]), ("T", [])]))
    got = by_hand(readers.read_chapters(listed(spark, tmp_path)).select("filename", "chapter_id", "title", "content"))
    assert got == [("01_t.xlsx", "ch_01", "01_t - Z", "h, Unnamed: 1, h.1, k\nx\n1"), ("01_t.xlsx", "ch_02", "01_t - A", "p\nq"), ("u.xlsx", "ch_01", "u", "only,head\n\n\n")]


def test_pdf_files_are_read_and_none_is_lost(spark, tmp_path):
    from test_pdf import PAGE, make

    body = rb"BT /F1 10 Tf 50 700 Td (some text of the page) Tj 0 -14 Td (3) Tj ET"
    (tmp_path / "01_p.pdf").write_bytes(make([body, PAGE, body], [(1, "A", 1), (2, "B", 2)]))
    (tmp_path / "plain.pdf").write_bytes(make([body, body]))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    files = listed(spark, tmp_path)
    rows = {(r.filename, r.chapter_id): r for r in readers.read_chapters(files).collect()}
    assert set(rows) == {("01_p.pdf", "ch_01"), ("plain.pdf", "ch_01"), ("broken.pdf", None)}
    p = rows["01_p.pdf", "ch_01"]
    assert (p.title, p.page_start, p.page_end, p.content) == ("Chapter 1 (A)", 2, 3, "Chapter 1 (A)\nWords\nnext line\n第一章竡\nsome text of the page")
    assert rows["plain.pdf", "ch_01"].title == "plain" and rows["plain.pdf", "ch_01"].page_end == 2
    assert "no pages" in rows["broken.pdf", None].error and rows["broken.pdf", None].content is None
    assert by_hand(readers.pdf_outline(files)) == [("01_p", 0, 1, "A", 1), ("01_p", 1, 2, "B", 2)]
    assert {r.filename: r.total_pages for r in readers.read_books(readers.read_chapters(files)).collect()} == {"01_p.pdf": 3, "plain.pdf": 2, "broken.pdf": 0}


def test_results_are_kept_by_content(spark, tmp_path):
    from lexforge.sources.cache import cached, spliced

    made = spark.sparkContext.accumulator(0)

    def step(new):
        made.add(new.count())
        return new.withColumn("size", F.length("text")).drop("text")

    first = spark.createDataFrame([("a", "xx"), ("b", "yyy"), ("c", "xx")], "name string, text string")
    assert by_hand(cached(first, "text", step, str(tmp_path / "c")).select("name", "size")) == [("a", 2), ("b", 3), ("c", 2)]
    then = spark.createDataFrame([("a", "zzzz"), ("d", "yyy")], "name string, text string")
    assert by_hand(cached(then, "text", step, str(tmp_path / "c")).select("name", "size")) == [("a", 4), ("d", 3)]
    assert made.value == 3
    sections = spark.createDataFrame([("b", 0, 0), ("b", 0, 1)], "book string, ch_idx int, sec_idx int")
    items = spark.createDataFrame([("b", 0, 1, 0, "n", "总结"), ("b", 7, 0, 0, "gone", None)], "book string, ch_idx int, sec_idx int, ord int, name string, type string")
    assert [[i.name for i in r["items"]] for r in spliced(sections, items).orderBy("sec_idx").collect()] == [[], ["n"]]


def test_models_errors_progress_and_places(spark, tmp_path):
    def broken():
        def model(messages):
            if "bad" in messages[-1]["content"]:
                raise ValueError("refused")
            return messages[0]["role"]

        return model

    rows = spark.createDataFrame([("good",), ("bad",)], "t string")
    progress = plugins.Progress(spark, 4)
    got = {r.t: (r.raw, r.raw_error) for r in plugins.ask(rows, "t", broken, system="S", progress=progress).collect()}
    assert got == {"good": ("system", None), "bad": (None, "refused")}
    assert progress.done == 2 and progress.share() == 0.5 and progress.seconds_left(progress.began + 10) == 10
    assert plugins.Progress(spark, 1).seconds_left() is None
    (tmp_path / "m").mkdir()
    assert plugins.resolve_model("m", folders=(str(tmp_path),)) == str(tmp_path / "m")
    assert plugins.resolve_model("m", mirror=lambda n: str(tmp_path)) == str(tmp_path)
    assert plugins.resolve_model("x/m", mirror=lambda n: 1 / 0) == "x/m"
    assert plugins.once("k", lambda: [1]) is plugins.once("k", lambda: [2])
