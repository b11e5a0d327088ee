from conftest import by_hand
from pyspark.sql import functions as F

from lexforge.llm import repeated as r

SCHEMA = "source string, doc_no int, text string, line string, documents int"


def docs(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)


def found(spark, rows):
    d = docs(spark, rows)
    _, crossed = r.update(r.no_lines(d), d)
    return by_hand(r.found_lines(d, crossed.where("now_repeated").select("source", "line_key")))


def test_wordings_compare_without_signs_digits_case_and_width(spark):
    rows = [("a", 1, "Ｃopyright 2001!\n\nbody one"), ("a", 2, "* COPYRIGHT 2002\nbody two"), ("a", 3, "other\n  copy-right"), ("a", 4, None), *[("a", i, f"text {chr(96 + i)}x") for i in range(5, 13)]]
    assert found(spark, rows) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1)]


def test_a_quarter_counts_documents_without_content_and_each_delivery_once(spark):
    rows = [("a", 1, "note\nnote"), ("a", 1, "note\nnote"), *[("a", i, None) for i in range(2, 5)]]
    assert found(spark, rows) == [("a", 1, 0), ("a", 1, 1)]
    assert found(spark, [*rows, ("a", 5, " ")]) == []


def test_lines_without_letters_null_sources_and_nothing(spark):
    assert found(spark, [("a", 1, "---\n12\n　"), (None, 2, "x"), ("b", 1, "")]) == []
    assert found(spark, []) == []


def test_batches_give_what_one_run_gives(spark, tmp_path):
    one = [("a", i, f"note\nown words {chr(97 + i)}") for i in range(4)] + [("b", 1, "q"), ("b", 2, "q")]
    two = [("a", i, f"own words {chr(97 + i)}") for i in range(4, 20)] + [("b", 3, "new\nq")]
    first, crossed = r.update(r.no_lines(docs(spark, one)), docs(spark, one))
    assert crossed.where("now_repeated").count() > 0
    r.save(first, str(tmp_path / "t"))
    then, crossed = r.update(r.load(spark, str(tmp_path / "t")), docs(spark, two))
    whole = r.count_lines(docs(spark, one + two))
    for name in ("lines", "sources", "holders", "known"):
        assert by_hand(getattr(then, name)) == by_hand(getattr(whole, name))
    # note fell below a quarter, new rose to a third, and only documents with them are built anew
    touched = by_hand(r.documents_to_rebuild(then.holders, crossed))
    assert ("b", 3) in touched and ("a", 0) in touched and ("b", 1) not in touched


def test_documents_that_come_again_count_once(spark):
    one = [("a", i, f"note\nwords {chr(97 + i)}") for i in range(3)] + [("a", i, f"words {chr(97 + i)}") for i in range(3, 9)]
    two = [*one[:4], ("a", 9, "words x"), ("a", 0, "another delivery of it"), ("a", 10, None)]
    state = r.add_batch(r.add_batch(r.add_batch(None, docs(spark, one)), docs(spark, two)), docs(spark, two))
    whole = r.count_lines(docs(spark, one + two))
    assert by_hand(state.tables.lines) == by_hand(whole.lines) and by_hand(state.tables.sources) == by_hand(whole.sources) == [("a", 11)]
    assert by_hand(state.keys) == by_hand(r.repeated(whole))


def test_two_deltas_clean_as_a_full_run_and_build_only_what_changed(spark):
    one = [("a", i, f"note\nold words {chr(97 + i)}") for i in range(4)] + [("b", 1, "q\nb one"), ("b", 2, "q\nb two")]
    two = [("a", i, f"own words {chr(97 + i)}\nlate") for i in range(4, 20)]
    three = [("b", 3, None), ("c", 1, "z\ny"), ("a", 20, "late\nlast")]
    state, sizes = None, []
    for rows in (one, two, three):
        state = r.add_batch(state, docs(spark, rows))
        sizes.append(by_hand(state.touched))
    full = docs(spark, one + two + three)
    assert by_hand(state.texts.select("source", "doc_no", F.coalesce("text", F.lit("<null>")))) == by_hand(r.without_lines(full, r.repeated(r.count_lines(full))).select("source", "doc_no", F.coalesce("text", F.lit("<null>"))))
    # the second batch brings note back into the first documents of a, and leaves b alone; the third touches its own only
    assert sizes[1] == [("a", i) for i in range(20)]
    assert sizes[2] == [("a", 20), ("b", 3), ("c", 1)]


def test_cleaning(spark):
    d = docs(spark, [("a", 1, "note\nbody\n"), ("a", 2, "note"), ("a", 3, None), *[("a", i, f"t{chr(97 + i)}") for i in range(4, 9)]])
    keys = r.repeated(r.count_lines(d))
    got = {x.doc_no: x.text for x in r.without_lines(d, keys).collect()}
    assert got[1] == "body\n" and got[2] == "" and got[3] is None and got[4] == "te"


def test_hot_source_and_long_text(spark):
    rows = [("hot", i, f"note\nline {i}") for i in range(2000)] + [("b", 1, "long " * 50_000)]
    assert len(found(spark, rows)) == 2000 * 2 + 1
