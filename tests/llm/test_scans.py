import numpy as np
from conftest import by_hand
from pyspark.sql import functions as F

from lexforge.llm import scans as s

ODD = ["deterrninant", "elernent", "cornpound", "polynornial"]
AT = {3: (4, "的机"), 4: (4, "的原"), 5: (3, "的分")}
CH = "textbook_id string, ord int, title string, content string, page_start int, page_end int, notices string, key string"
BK = "textbook_id string, title string, filename string"
SENTENCES = ["the manifold is only measurable when the polynomial element of a compound is constant", "a determinant of the steady-state integral will follow at once", "the polynomial follows a steady-state determinant without any manifold", "线粒体的分布在上行条件下会逐渐出现，并伴随线粒体的变化", "与线粒体相比，间质的机制更稳定的原因是间质"]


def test_page_numbers():
    for text in ("7", "- 7 -", "·7·", "[7]", "Page 7", "P a g e 7", "第 7 页", "7 / 301", "vii", "— 7 —", "７", "- - - - - - - - - 7 - - - - - - - - -"):
        assert s.page_number(text, 5, 9)[0] == 7, text
    for text in ("(7.2)", "17", "7.5", "y = 7", "", "Table 7", "seven", "7月"):
        assert not s.page_number(text, 5, 9), text
    assert s.page_number("- 7 -", 5, 9)[1] == s.page_number("- 8 -", 5, 9)[1] != s.page_number("8", 5, 9)[1]


def numbers(text, first=5, last=9):
    found = [(k, s.page_number(x, first, last)) for k, x in enumerate(text)]
    return [s.Number(k, *f) for k, f in found if f]


def test_page_numbers_are_a_sequence():
    plain = [f"line {chr(97 + k)}" for k in range(6)]
    text = [*plain, "- 5 -", *plain[:3], "7", *plain[:3], "- 6 -", *plain, "- 7 -", "8", *plain, "- 8 -"]
    kept = [text[x.place] for x in s.sequence(numbers(text), len(text), True)]
    assert kept == ["- 5 -", "- 6 -", "- 7 -", "- 8 -"]
    # lone integers of the text in no order, and a column of them
    assert [x.page for x in s.sequence(numbers([*plain, "9", *plain, "5", *plain, "6", *plain, "7"]), 28, True)] == [5, 6, 7]
    assert s.sequence(numbers([*plain, "7", *plain]), 13, True) == []
    assert [x.page for x in s.sequence(numbers([*plain, "7", *plain]), 13, True, frozenset(["1"]))] == [7]
    assert [x.page for x in s.sequence(numbers([*plain, "7"]), 7, True)] == [7]
    # unknown pages: numbers that rise from page to page, but no column of a table
    assert [x.page for x in s.sequence(numbers([*plain, "40", *plain, "41", *plain, "42"], None, None), 21, False)] == [40, 41, 42]
    assert s.sequence(numbers(["40", "41", "42", "47"], None, None), 4, False) == []
    assert s.sequence(numbers([*plain, "7"], None, None), 7, False) == []


def test_likeness_of_heads():
    assert s.alike("calculuslecturenotes", "calculuslecturenote") and s.alike("abcdefghij", "abcdefghix")
    assert not s.alike("abc", "xyz") and not s.alike("", "") and not s.alike("ab", "abcdef")
    assert s.alike("abcdefghij", "xabcdefghi") and not s.alike("abcdefghij", "xyabcdefgh")


def corpus():
    pairs = np.zeros(s.BUCKETS, np.int64)
    for a, b, n in (("线", "粒", 90), ("粒", "体", 90), ("的", "分", 50), ("体", "的", 80), ("粒", "休", 1), ("休", "的", 1)):
        pairs[(ord(a) * 40_503 + ord(b) * 65_599) & (s.BUCKETS - 1)] = n
    return s.Corpus(pairs, {"休": ["体"]})


WORDS = {"polynomial": 90, "steady-state": 40, "steady": 3, "state": 9, "the": 500, "determinant": 80, "follow": 30, "condition": 40, "conditions": 90, "as": 30, "well-known": 40, "well": 9, "known": 30, "compound": 60, "element": 70}
MISREAD = {"polynornial": 2, "deterrninant": 1, "cornpound": 1, "elernent": 3, "conditi0ns": 1, "comp0und": 1, "polyn0mial": 2, "h2o": 9}


def words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_confusions_are_learnt(spark):
    assert s.confusions(words(spark, WORDS | MISREAD)) == {"rn": ["m"], "0": ["o"]}
    # any sign, written down nowhere
    one = {"polynømial": 1, "conditiøns": 2, "cømpøund": 1, "compøund": 1}
    assert s.confusions(words(spark, WORDS | one)) == {"ø": ["o"]}
    # endings that change are no misreadings
    many = {w: 90 for w in ("follows", "belongs", "demands", "returns", "expects")} | {w[:-1] + "d": 1 for w in ("follows", "belongs", "demands", "returns", "expects")}
    assert s.confusions(words(spark, many)) == {}
    assert s.confusions(words(spark, {})) == {}


def test_misread_words(spark):
    counts = words(spark, WORDS | MISREAD)
    forms = spark.createDataFrame([(w,) for w in ["polynornial", "c0nditions", "c~ndition", "steady-deterrninant", "polynomial", "h2o", "unknown", "x" * 3000]], "word string")
    got = dict(by_hand(s.readings_of(forms, counts, counts.where("n >= 3"))))
    assert got == {"deterrninant": "determinant", "polynornial": "polynomial", "c0nditions": "conditions", "c~ndition": "condition", "steady-deterrninant": "steady-determinant"}


def test_cut_words_and_compounds(spark):
    counts = words(spark, WORDS)
    pairs = [("poly", "nomial"), ("deter", "minant"), ("steady", "state"), ("well", "known"), ("unk", "nown"), ("state", "known")]
    none = spark.createDataFrame([], "word string, right string")
    assert by_hand(s.cut_pairs(spark.createDataFrame(pairs, "a string, b string"), counts, none)) == [("deter", "minant"), ("poly", "nomial"), ("unk", "nown")]
    assert s.parts_at("after the épreu-", "vée de") == ("épreu", "vée") and s.parts_at("在steady-", "state") == ("steady", "state") and s.parts_at("no", "cut") is None


def test_characters_against_their_neighbours():
    c = corpus()
    assert s.misread_han("线粒休的分", c) == [(2, "体")] and s.misread_han("线粒体的分", c) == []


def test_look_alikes_are_learnt(spark):
    text = ["线粒体的分布", "间质体的机制", "个体的原因", "整体的变化"]
    grams, pairs = {}, np.zeros(s.BUCKETS, np.int64)
    for t, n in [*((t, 400) for t in text), *((t.replace("体", "休"), 2) for t in text), ("休息的时间", 1)]:
        code = [ord(x) for x in t]
        for a, b in zip(code, code[1:], strict=False):
            pairs[(a * 40_503 + b * 65_599) & (s.BUCKETS - 1)] += n
        for a, b, c in zip([0, *code[:-1]], code, [*code[1:], 0], strict=True):
            grams[(a << 32) | (b << 16) | c] = grams.get((a << 32) | (b << 16) | c, 0) + n
    made = spark.createDataFrame(list(grams.items()), "gram long, n long")
    assert s.look_alikes(made, pairs.astype(np.int32)) == {"休": ["体"]}


def chapters(spark):
    body = [" ".join(SENTENCES[i % 3] for i in range(k, k + 3)) for k in range(40)]
    rows = []
    for o in range(1, 13):
        first = o * 2
        said = list(SENTENCES)
        if o in AT:
            k, piece = AT[o]
            said[k] = said[k].replace(piece, piece.replace("的", "旳"))
        lines = [f"Chapter {o} Stable things", *body[:6], "It needs the poly-", "nomial and a steady-", f"state integral of the {ODD[o % 4]} kind that we have considered before", f"- {first} -", "All rights reserved", f"Stable Book {first}", said[3] + "。", said[4] + "。", "12.5", f"- {first + 1} -", "All rights reserved"]
        rows.append(("b1", o, f"Chapter {o} Stable things", "\n".join(lines), first, first + 1, "clash", "clash"))
    more = [("b2", i, "第一章 线粒体", "\n".join(["第一章 线粒体", *["线粒体的机制更稳定的原因是线粒体的分布" for _ in range(30)]]), 1, 2, "clash", "clash") for i in range(5)]
    return spark.createDataFrame(rows + more, CH), spark.createDataFrame([("b1", " Stable Book", "09_Stable Book.pdf"), ("b2", None, "x.PDF")], BK)


def test_lines_of_a_book(spark):
    got = by_hand(s.describe_lines(*chapters(spark)).where("textbook_id = 'b1' and ord = 3").select("line_no", "kind"))
    assert got == [(7, "hyphen"), (9, "glyph"), (10, "furniture"), (11, "furniture"), (12, "furniture"), (14, "glyph"), (16, "furniture"), (17, "furniture")]


def test_restored_text(spark):
    text = s.restore(*chapters(spark)).where("textbook_id = 'b1' and ord = 3").first().text
    assert "polynomial and a steady-state integral of the polynomial kind" in text
    assert "rights" not in text and "- 6 -" not in text and "旳" not in text and text.startswith("Chapter 3 Stable things")


def test_nulls_repeats_nothing_and_long_text(spark):
    ch, bk = chapters(spark)
    odd = spark.createDataFrame([("b1", 50, None, None, None, None, "c", "c"), ("b1", 51, None, "", 1, 1, "c", "c"), (None, 1, "t", "- 1 -", 1, 1, "c", "c"), ("b9", 1, None, "word " * 40_000, None, None, "c", "c")], CH)
    plain = by_hand(s.describe_lines(ch, bk))
    assert by_hand(s.describe_lines(ch.unionByName(odd).unionByName(ch), bk).where("textbook_id <> 'b9'")) == plain
    assert s.describe_lines(ch.limit(0), bk).count() == 0 and s.restore(ch.limit(0), bk.limit(0)).count() == 0


def test_running_lines_that_no_table_names(spark):
    notice = "This copy was made for the reading room of the library and must not be lent or sold to anybody."
    rows = []
    for o in range(1, 9):
        lines = [f"Chapter {o} Of {'abcdefghi'[o]}things"]
        for page in (2 * o, 2 * o + 1):
            head = "Secret Serics of Things" if page == 7 else "Secret Series of Things"
            lines += [f"{SENTENCES[k % 3]} {chr(97 + k)}{chr(97 + page)}" for k in range(18)]
            # an integer of the text that is one of the chapter's pages
            lines += [str(2 * o + 1), f"it was {'abcdefghi'[o]} then", notice, f"- {page} -", head]
        rows.append(("b3", o, None, "\n".join(lines), 2 * o, 2 * o + 1, "c", "c"))
    books = spark.createDataFrame([("b3", None, "scan.pdf")], BK)
    got = by_hand(s.describe_lines(spark.createDataFrame(rows, CH), books).where("kind = 'furniture'").select("ord", "line_no"))
    assert got == [(o, i) for o in range(1, 9) for i in (21, 22, 23, 44, 45, 46)]


def test_words_of_other_books_count(spark):
    ch, bk = chapters(spark)
    ch = ch.where("textbook_id = 'b1' and ord = 3")
    assert ("b1", 3, 9, "glyph") not in by_hand(s.describe_lines(ch, bk))
    others = spark.createDataFrame([(f"x {w} y",) for w in ["polynomial"] * 30 + ["determinant"] * 30 + ["element"] * 30 + ["compound"] * 30 + ["deterrninant", "elernent", "cornpound"]], "content string").withColumn("content", F.concat_ws(" ", "content", F.monotonically_increasing_id().cast("string")))
    assert ("b1", 3, 9, "glyph") in by_hand(s.describe_lines(ch, bk, others))
