import math

import numpy as np
import pytest
from conftest import by_hand

from lexforge.llm import survivors as s

SCHEMA = "id string, name string, definition string, importance_level string, textbook_id string, page int, embedding array<float>, key string, block int, concept string"
V, W = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
FULL = "细胞核复制模型是指细胞核在复制过程中形成的模型，其数值一般为93.1小时。线粒体缓冲一旦受到外界干扰，干涉过程就会中断。"
SHORT = "细胞核复制模型是指细胞核在复制过程中形成的模型，其数值一般为93.1小时。"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5, "clash") for r in rows], SCHEMA)


def found(spark, rows, **kw):
    got = s.survivors(frame(spark, rows), **kw)
    return by_hand(got.where("n_ids > 1").select("first_id", "best_id", "n_ids"))


def node(i, definition, name="细胞核复制模型", book="b", vector=V, level="重要", page=3):
    return (i, name, definition, level, book, page, vector)


@pytest.mark.parametrize(
    "worse",
    [SHORT, None, "", "  ", "TODO", FULL[:50], SHORT * 4, FULL.replace("复", "□"), FULL.replace("缓", "?"), FULL.replace("数", "&#x;"), f"<p class=\"def\"><span>{SHORT}</span></p>&nbsp;<br/>&nbsp;", FULL[:45] + "……………………………………", '```json {"definition": "' + SHORT],
)
def test_whole_clean_and_most_complete_survives(spark, worse):
    assert found(spark, [node("n1", worse), node("n2", FULL), node("n3", SHORT)]) == [("n1", "n2", 3)]


def test_names_written_differently(spark):
    names = ["细胞核复制模型", " 细胞核​复制模型", "模型（细胞核复制）", "（一）细胞核复制模型", "1、细胞核复制模型", "《细胞核复制模型》", "细胞核复制模型（定义）", "细胞核的复制模型", "①细胞核复制模型"]
    assert {s.canonical(n) for n in names} == {"细胞核复制模型"}
    assert s.canonical("型Ａ") == "型a" and s.canonical(None) is None and s.canonical(" 。") is None


def test_misread_characters_are_learnt(spark):
    keys = [(f"{a}体{b}",) for a in "叶导晶" for b in ("收敛", "振荡", "分泌", "吸收")] + [("叶休收敛",)] + [("横向膜",), ("纵向膜",)]
    assert s.misread(spark.createDataFrame(keys, "key string")) == {"休": "体"}


def test_opposites_and_one_name_for_two_concepts(spark):
    rows = [node("n1", FULL), node("n2", SHORT), node("n3", FULL, vector=W, book="c"), node("n4", SHORT, vector=W, book="c"), node("n5", FULL, name="细胞核分解模型")]
    assert found(spark, rows) == [("n1", "n1", 2), ("n3", "n3", 2)]


def test_rows_without_a_vector_go_with_their_wording_or_book(spark):
    other = "细胞核复制模型：衡量编译器程度的准则，取值越大说明总线越明显，临界值为324.9。"
    rows = [node("n1", FULL), node("n2", SHORT, vector=None, book="x"), node("n3", None, vector=[0.0, 0.0, 0.0]), node("n4", other, vector=None, book="y"), node("n5", "TODO", vector=[1.0])]
    assert found(spark, rows) == [("n1", "n1", 4)]


def test_nameless_records_are_found_by_their_first_sentence(spark):
    rows = [node("n1", FULL), node("n2", SHORT, name=None), node("n3", "别的内容说明了另一件事情。", name=None), node("n4", None, name=None)]
    assert found(spark, rows) == [("n1", "n1", 2)]


def test_fields_come_from_the_best_values(spark):
    rows = [node("n1", SHORT, level=" 关键", page=9), node("n2", FULL, level="核心", page=-1, book="c"), node("n3", None, level=None, page=None)]
    got = s.survivors(frame(spark, rows)).first()
    assert (got.definition, got.importance_level, got.page, got.textbook_id, got.name) == (FULL, "关键", 9, "c", "细胞核复制模型")


def test_repeats_ties_nothing_and_null_ids(spark):
    assert found(spark, [node("n2", FULL), node("n1", FULL), node("n1", FULL), node(None, FULL)]) == [("n1", "n1", 2)]
    assert found(spark, [node("n1", FULL), node("n1", FULL)]) == []
    assert s.survivors(frame(spark, [])).count() == 0


def test_a_hot_name_gives_the_same_as_a_small_one(spark):
    rows = [node(f"n{i:03}", [SHORT, None, FULL[:50], SHORT * 3][i % 4], book=f"b{i % 5}") for i in range(90)] + [node("n999", FULL)]
    rows += [node(f"m{i}", SHORT, vector=W, book="z") for i in range(3)]
    assert found(spark, rows, block=16) == found(spark, rows) == [("m0", "m0", 3), ("n000", "n999", 91)]


def test_consensus_by_columns():
    clean, lost = "abcdefghijklmnopqrstuvwxyz.", "abc□efghi□klmnopqrst□vwxyz."
    assert s.consensus([(lost, 1.0), (clean, 4.0), (clean[:15], 1.0)]) == clean
    assert s.consensus([("abcXefghijklmnop.", 1.0), ("abcdefghijklmnop.", 1.0), ("abcdefghijklmnop.", 1.0)]) == "abcdefghijklmnop."
    assert s.consensus([]) == "" and s.distance("abc", "abc") == 0 and s.distance("abcd", "abd") == 1


def common(a, b):
    """Length of the longest common subsequence, plainly."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@pytest.mark.parametrize("size", [20, 190, 199, 200, 201, 210, 450])
def test_alignments_have_the_most_matches_at_any_size(size):
    rng = np.random.default_rng(size)
    a, b = ("".join(rng.choice(list("abcdefgh"), size)) for _ in "ab")
    a, b = f"x{a}y", f"z{b}w"
    pairs = s.align(list(a), b)
    both = [(x, y) for x, y in pairs if x is not None and y is not None]
    assert [x for x, _ in pairs if x is not None] == list(range(len(a))) and [y for _, y in pairs if y is not None] == list(range(len(b)))
    assert all(a[x] == b[y] for x, y in both) and len(both) == common(a, b)


def test_long_names_are_repaired(spark):
    long = "很" * 150
    keys = [(f"{long}{a}体{b}",) for a in "叶导晶" for b in ("收敛", "振荡", "分泌", "吸收")] + [(f"{long}叶休收敛",)]
    assert s.misread(spark.createDataFrame(keys, "key string")) == {"休": "体"}


def test_long_first_sentences_find_nameless_records(spark):
    long = "第一点" + "说明了细胞核在复制过程中形成的各种模型" * 20 + "。"
    assert found(spark, [node("n1", long + "然后。"), node("n2", long, name=None)]) == [("n1", "n1", 2)]


def test_very_long_values(spark):
    long = "".join(f"第{i}点说明细胞核的复制过程。" for i in range(6000))
    rows = [node("n1", long), node("n2", long[:-7] + "。"), node("n3", long.replace("第77点", "第□7点"))]
    assert found(spark, rows) == [("n1", "n1", 3)]


def test_copies_of_one_name_make_no_clause_common(spark):
    chatter = "以上内容仅供参考，如需进一步展开请告诉我。"
    rows = [node(f"n{i:03}", SHORT, vector=None) for i in range(60)] + [node("n999", FULL)] + [node(f"m{i}", f"第{i}种概念说明了不同的事情和条件。" + chatter, name=f"概念{'甲乙丙丁戊己庚辛'[i]}") for i in range(8)]
    assert s.common_clauses(frame(spark, rows).drop("key").withColumnRenamed("name", "key")) == [chatter[:-1]]
    assert found(spark, rows) == [("n000", "n999", 61)]


def test_concepts_of_a_large_group_are_components_as_in_a_small_one(spark, monkeypatch):
    monkeypatch.setattr(s, "VECTORS", 4)
    # two fans of vectors, each linked from neighbour to neighbour only, and a single one
    fan = lambda a, b, n: [[math.cos(k) if i == a else math.sin(k) if i == b else 0.0 for i in range(5)] for k in np.linspace(0, 2.8, n)]
    vectors = [*fan(0, 1, 9), *fan(2, 3, 7), [0.0, 0.0, 0.0, 0.0, 1.0]]
    rows = [node(f"n{(7 * i) % 17:02}", FULL, vector=v) for i, v in enumerate(vectors)]
    want = found(spark, rows, block=1000)
    assert sorted(n for _, _, n in want) == [7, 9]
    assert found(spark, rows, block=4) == want
    assert found(spark, rows * 2, block=4) == want


def test_records_without_a_vector_go_where_they_go_in_a_small_name(spark):
    name = "细胞核复制模型"
    one = f"{name}是指细胞核在复制过程中形成的模型，其数值一般为93.1小时。线粒体缓冲一旦受到外界干扰，干涉过程就会中断。"
    two = f"{name}：衡量编译器程度的准则，取值越大说明总线越明显，临界值为324.9。它在后续章节中还会反复出现。"
    rows = [node(f"a{i}", one, book="p") for i in range(7)] + [node(f"b{i}", two, book="q", vector=W) for i in range(5)]
    rows += [
        node("c1", two[:60], book="p", vector=None),  # the wording of the second, though the book of the first
        node("c2", "TODO", book="q", vector=None),  # nothing said: the book
        node("c3", None, book="z", vector=[0.0, 0.0, 0.0]),  # nothing at all: the largest
        node("c4", "细胞核的复制由模型描述，这是另一种说法，内容与前文都不同。", book="z", vector=None),  # on the topic
        node("c5", "总线仲裁的编译准则在此不再赘述，请参阅其他章节的有关说明。", book=None, vector=None),  # off the topic
    ]
    want = found(spark, rows, block=1000)
    assert want == [("a0", "a0", 9), ("b0", "b0", 8)]
    assert found(spark, rows, block=4) == want
