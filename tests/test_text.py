from conftest import by_hand
from pyspark.sql import functions as F

from lexforge.functions import text as t
from lexforge.functions import vector as v


def one(spark, column, *values):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_and_keys(spark):
    assert one(spark, t.strip, "　a b ", "\t\n", None) == ["a b", "", None]
    assert one(spark, t.node_key, " Book_N1 ", "　", None) == ["book_n1", None, None]
    assert one(spark, t.wording, "Ａ1·b-c　中") == ["abc中"]


def test_chapter_numbers(spark):
    assert one(spark, t.chapter_number, "第十二章 极限", "chapter 3", "第零章", "见第二章", "第二十章", "第 5 章") == [12, 3, 0, None, 20, 5]


def test_footers(spark):
    assert one(spark, t.is_footer, "12", "第 3 页", "版权所有 2020", " ", "1" * 40, "正文") == [True, True, True, True, False, False]


def test_titles_ids_and_lengths(spark):
    assert one(spark, t.book_title, "01_高等数学.md", "1_x.md", "2020-x.md") == ["高等数学", "1_x", "2020-x"]
    assert one(spark, t.book_id, "01_高等数学.pdf") == ["book_72ae2c25"]
    assert one(spark, t.visible_length, "a b\nc\t") == [4]


def test_marks_domains_compression_and_json(spark):
    assert one(spark, t.page_mark, "x [第12页] y [第3页]", "x") == [12, 0]
    assert one(spark, t.without_page_marks, "[第2页]\n ab") == ["ab"]
    assert one(spark, t.domain_key, "极限论第一章", "第一章 极限", "Introduction") == ["极限论", "", "Introd"]
    assert one(spark, t.compressed, "a" * 100, "a" * 101) == ["a" * 100, "a" * 97 + "..."]
    assert one(spark, t.json_body, '```json\n{"a": 1}\n```', "none") == ['{"a": 1}', None]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = by_hand(rows.select(F.round(v.cosine(F.col("a"), F.col("b")), 4), v.unit(F.col("a"))).orderBy("unit(a)") if False else rows.select(F.coalesce(F.round(v.cosine(F.col("a"), F.col("b")), 4), F.lit(-9.0))))
    assert got == [(-9.0,), (0.7071,)]


def test_labels_questions_and_unicode_forms(spark):
    assert one(spark, t.clean_name, " \ufeff名\u200b ", "a") == ["名\u200b", "a"]
    assert one(spark, t.choice_question, "  📄 极限", "", "📘 x") == ["请详细解释「极限」的内容，包括其数学表述和相关背景。", "", "请详细解释「x」的内容，包括其数学表述和相关背景。"]
    assert one(spark, t.chapter_number, "第　十二　章", "第１２章", "CHAPTER　３") == [12, 12, 3]
    assert one(spark, t.is_footer, "１２", "第　３　页", "x１") == [True, True, False]
    assert one(spark, t.page_mark, "a[第１２页]b", "none") == [12, 0]
    assert one(spark, t.json_body, '```python {"a": 1}```', '``` {"b": 2}\n```') == ['{"a": 1}', '{"b": 2}']
