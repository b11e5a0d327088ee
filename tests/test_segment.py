from conftest import by_hand

from lexforge.operators import dashboard as b
from lexforge.operators import segment as s


def md(spark, text):
    return [(r.title, r.content) for r in s.markdown_chapters(spark.createDataFrame([("b", text)], "book string, content string")).orderBy("line_no").collect()]


def test_markdown(spark):
    assert md(spark, "a\n# T\nb") == [("前言", "a"), ("T", "b")]
    assert md(spark, "# A\n# B\nx") == [("B", "x")]
    assert md(spark, "\n# A\n") == [("前言", ""), ("A", "")]
    assert md(spark, "#### D\nx") == [("前言", "#### D\nx")]
    assert md(spark, None) == []


def page_lines(spark, rows):
    return spark.createDataFrame(rows, "textbook_id string, page_idx int, line_idx int, text string, size double, is_bold boolean")


def test_body_size_is_the_upper_median(spark):
    rows = [("t", 0, i, "x" * 11, float(z), False) for i, z in enumerate((10, 11, 12, 13))] + [("u", 0, 0, "short", 20.0, False)]
    assert by_hand(s.body_font_size(page_lines(spark, rows))) == [("t", 12.0), ("u", 11.0)]


def test_pdf_chapters(spark):
    rows = [("t", p, 0, f"body of page {p} is long enough", 10.0, False) for p in range(9)]
    rows += [("t", 2, -1, "第一章 甲", 14.0, True), ("t", 5, -1, "Chapter 2 B", 14.0, False), ("t", 5, 9, "12", 10.0, False)]
    got = s.pdf_chapters(page_lines(spark, rows), spark.createDataFrame([("t", 9)], "textbook_id string, total_pages int"))
    assert by_hand(got.select("chapter_id", "title", "page_start", "page_end")) == [("ch_01", "第一章 甲", 3, 5), ("ch_02", "Chapter 2 B", 6, 9)]
    assert "12" not in got.where("chapter_id = 'ch_02'").first().content.split("\n")


def test_outline(spark):
    toc = spark.createDataFrame([("b", 1, 1, "A", 1), ("b", 2, 2, "a", 2), ("b", 3, 1, "前言", 3), ("b", 4, 2, "p", 4), ("b", 5, 3, "q", 5)], "book string, ord int, level int, title string, page int")
    assert by_hand(s.outline_tree(toc).select("ord", "title").fillna("")) == [(1, "A"), (2, "a"), (4, "p")]
    assert {r.ord: r.parent_ord for r in s.outline_tree(toc).collect()} == {1: None, 2: 1, 4: 1}
    lone = spark.createDataFrame([("b", 1, 2, "a", 2)], "book string, ord int, level int, title string, page int")
    assert s.outline_tree(lone).count() == 0


def test_pages_to_sections(spark):
    pages = spark.createDataFrame([("b", p) for p in (1, 3, 6, 9, 10)], "book string, page int")
    sections = spark.createDataFrame([("b", 1, 3, "s1"), ("b", 2, 7, "s2"), ("b", 3, 10, "s3")], "book string, ord int, page int, title string")
    got = s.pages_to_sections(pages, sections).orderBy("page").collect()
    assert [r.sec_title for r in got] == [None, "s1", "s1", "s2", "s3"]


def test_recognition_and_summaries(spark):
    lines = spark.createDataFrame([("b", 0, 1, "two", 0.61), ("b", 0, 0, "one", 0.9), ("b", 0, 2, "no", 0.6), ("b", 1, 0, "z", 1.0)], "book string, page_idx int, line_idx int, text string, score double")
    pages = s.recognised_pages(lines)
    assert by_hand(pages) == [("b", 0, "one\ntwo"), ("b", 1, "z")]
    assert s.full_text(pages).first().text == "[第1页]\none\ntwo\n\n[第2页]\nz"
    told = s.summary_lines(spark.createDataFrame([("b", "[0] x\n[2] y\n[2] z\nnoise")], "book string, raw string"))
    assert by_hand(told) == [("b", 0, "x"), ("b", 2, "z")]
    full = s.with_summaries(spark.createDataFrame([("b", i) for i in range(3)], "book string, number int"), told)
    assert [r.summary for r in full.orderBy("number").collect()] == ["x", "", "z"]
    long = spark.createDataFrame([("b", 0, 1, "x" * 60), ("b", 1, 2, "short")], "book string, page_idx int, sec_ord int, text string")
    assert [r.sec_ord for r in s.section_texts(long).collect()] == [1]


def test_statements(spark):
    rows = spark.createDataFrame([(1, "定义 1.2 极限是一个数值概念 定理 3 有界数列必有收敛子列 证明 略。定义 1.2 又一次说明极限")], "i int, text string")
    assert by_hand(s.statements(rows, ["i"])) == [(1, "定义", "定义 1.2", "极限是一个数值概念"), (1, "定理", "定理 3", "有界数列必有收敛子列")]


def test_books_without_headings_are_one_chapter(spark):
    rows = [("t", p, 0, f"text of page {p} without any heading", 10.0, False) for p in range(3)] + [("t", 1, 1, "12", 10.0, False)]
    total = spark.createDataFrame([("t", 3, "T"), ("empty", 2, "E")], "textbook_id string, total_pages int, book_title string")
    got = by_hand(s.pdf_chapters(page_lines(spark, rows), total).select("textbook_id", "chapter_id", "title", "page_start", "page_end", "content"))
    assert got == [("empty", "ch_01", "E", 1, 2, ""), ("t", "ch_01", "T", 1, 3, "\n".join(f"text of page {p} without any heading" for p in range(3)))]


def test_sections_of_pages_with_ties_nulls_and_many_rows(spark):
    pages = spark.createDataFrame([("b", p, p % 3) for p in range(1, 400)] + [("b", 5, 9), ("b", 5, 9), (None, 3, 0), ("b", None, 0), ("c", 1, 0)], "book string, page int, x int")
    sections = spark.createDataFrame([("b", 1, 3, "s1"), ("b", 2, 5, "s2"), ("b", 3, 5, "s3"), ("b", 4, None, "no"), ("b", 5, 200, None)], "book string, ord int, page int, title string")
    got = s.pages_to_sections(pages, sections).collect()
    assert len(got) == 404
    want = lambda r: None if r.book != "b" or r.page is None or r.page < 3 else 1 if r.page < 5 else 3 if r.page < 200 else 5
    assert all(r.sec_ord == want(r) for r in got) and {r.sec_title for r in got if r.sec_ord == 3} == {"s3"}


def test_outline_shown_as_choices_rows_and_lists(spark):
    rows = [("b", None, [], 0, "B", None), ("c", "b", [1], 1, "C", None), ("s", "c", [1, 2], 2, "S", None), ("i", "s", [1, 2, 0], 3, "I", "总结"), ("d", "b", [5], 1, "D" * 80, "定理")]
    tree = spark.createDataFrame(rows, "node_id string, parent_id string, path array<int>, depth int, name string, type string")
    assert [r.label for r in b.choices(tree).orderBy("path").collect()] == ["📘 C", "  📄 S", "    📌 I", "📘 " + "D" * 80]
    assert b.choices(tree, most=2).count() == 2
    assert {r.label for r in b.shown_children(tree, children=1).collect()} == {"B", "C", "S", "📝 I"}
    assert {r.label for r in b.shown_children(tree).collect()} == {"B", "C", "S", "📝 I", "🔴 " + "D" * 60}
    assert by_hand(b.selector(tree).select("label", "chapter", "section")) == [("  I", "C", "S"), (" S", "C", "S")]
    books = spark.createDataFrame([(f"b{i}", f"T{i}", i, 10) for i in range(6)], "textbook_id string, title string, total_pages int, total_chars long")
    assert b.overview(books).first().titles == "T0, T1, T2, T3..." and b.overview(books.where("textbook_id < 'b2'")).first().titles == "T0, T1"
    assert b.graph_data((1, 2), None, None) == (1, 2) and b.graph_data(None, books, books)[0].first().textbook == "b0"
