import json

from conftest import by_hand

from lexforge.operators import records as r

N = "id string, name string, definition string, importance_level string, textbook_id string, chapter string, page int, ord long"


def raw(spark, *bodies):
    rows = [("b", i, "c", 7, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) for i, x in enumerate(bodies)]
    return spark.createDataFrame(rows, "textbook_id string, batch_no int, chapter string, page int, raw string")


def test_nodes_take_defaults_and_drop_what_is_wrong(spark):
    items = [
        {"local_id": "n1", "name": "x" * 25, "definition": "d", "importance_level": "关键", "page": 3},
        {"local_id": "n2", "name": "a", "definition": "d", "importance_level": "核心", "page": 3},
        {"local_id": "n3", "name": "a", "definition": "d", "page": 3},
        {"local_id": "n4", "name": "a", "definition": "d", "page": None},
        {"local_id": "n5", "definition": "d"},
        {"local_id": "n6", "name": None, "definition": "d"},
        {"local_id": "n7", "name": "a", "page": "28"},
        {"local_id": "n8", "name": "a", "page": 28.0},
        {"local_id": "n9", "name": "a", "page": 28.5},
    ]
    got = {x.local_id: x for x in r.parsed_nodes(raw(spark, "```json\n" + json.dumps({"nodes": items}) + "\n```", "no json", {"nodes": None})).collect()}
    assert set(got) == {"n1", "n3", "n5", "n7", "n8"}
    assert got["n1"].name == "x" * 20 and got["n3"].importance_level == "重要" and got["n5"].page == 7 and got["n5"].name == "" and got["n7"].page == 28 == got["n8"].page


def test_edges_need_both_ends_and_a_known_relation(spark):
    body = {"nodes": [{"local_id": "n1"}, {"local_id": "n2", "name": None}], "edges": [{"source": "n1", "target": "n2"}, {"source": "n1", "target": "n9"}, {"source": "n2", "target": "n1", "relation_type": "odd"}, {"source": "n2", "target": "n1", "relation_type": "contains", "description": "y" * 60}]}
    assert by_hand(r.parsed_edges(raw(spark, body)).select("source", "target", "relation_type", "description")) == [("n1", "n2", "parallel", ""), ("n2", "n1", "contains", "y" * 50)]


def test_merging_of_names(spark):
    rows = [("i1", " 极限", "ab", "重要", "b", "c", 9, 0), ("i2", "极限", "abcd", "补充", "b", "c", 3, 1), ("i3", "极限", "cdef", "关键", "b", "c", 5, 2), ("j1", "x", "", "补充", "b", "c", 1, 3), ("j2", "x", "", "重要", "b", "c", 1, 4)]
    got = by_hand(r.deduplicated_nodes(spark.createDataFrame(rows, N)).select("id", "name", "definition", "importance_level", "page"))
    assert got == [("i1", " 极限", "abcd", "关键", 3), ("j1", "x", "", "补充", 1)]


def test_numbers_and_resolved_ends(spark):
    nodes = spark.createDataFrame([("b", 0, 0, "n1", "A"), ("b", 0, 1, "n2", "B"), ("b", 1, 0, "n1", "A "), ("a", 0, 0, "n1", "Z")], "textbook_id string, batch_no int, pos int, local_id string, name string")
    n = r.numbered(nodes)
    assert by_hand(n.select("id", "name")) == [("a_n0001", "Z"), ("b_n0001", "A"), ("b_n0002", "B"), ("b_n0003", "A ")]
    edges = spark.createDataFrame([("b", 1, "n1", "n1", "contains"), ("b", 0, "n1", "n2", "parallel")], "textbook_id string, batch_no int, source string, target string, relation_type string")
    assert by_hand(r.resolved_edges(edges, n).select("source", "target")) == [("b_n0001", "b_n0001"), ("b_n0001", "b_n0002")]
    assert r.token_estimate(raw(spark, "abc", "abcd")).first().tokens == 3


def test_answers_about_whole_chapters(spark):
    items = [{"id": "k", "name": "A", "category": "定理/定律", "page": 4}, {"name": "B"}, {"id": "z"}, {"id": "y", "name": "C", "category": "?"}, {"id": "x", "name": "D", "definition": None}, {"id": "w", "name": "E", "page": 1.5}]
    edges = [{"source": "k", "target": "node_001"}, {"source": "k", "target": "y"}, {"source": "k", "target": "k", "relation_type": "odd"}, {"source": "node_001", "target": "k", "relation_type": "contains", "description": "d" * 90}, {"source": "k"}]
    answers = raw(spark, {"nodes": items, "edges": edges}, "nothing", {"nodes": [{"id": "other", "name": "O"}], "edges": [{"source": "k", "target": "other"}]})
    nodes = r.legacy_nodes(answers)
    assert by_hand(nodes.select("batch_no", "id", "name", "definition", "category", "page")) == [(0, "k", "A", "", "定理/定律", 4), (0, "node_001", "B", "", "核心概念", 7), (2, "other", "O", "", "核心概念", 7)]
    assert by_hand(r.legacy_edges(answers, nodes).select("source", "target", "relation_type", "description")) == [("k", "node_001", "parallel", ""), ("node_001", "k", "contains", "d" * 90)]
    assert [x.ok for x in answers.select("batch_no", r.is_answer("raw").alias("ok")).orderBy("batch_no").collect()] == [True, False, True]
