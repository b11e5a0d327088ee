import itertools
import tracemalloc

import pyarrow as pa
import pytest
from conftest import by_hand
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.operators import integrate as g
from lexforge.operators.prefix import last_known, running


def test_judge_rules(spark):
    rows = [("p", "q", 1, 2, 0.8, True, 0.9, "merge", ""), ("r", "s", 1, 3, 0.8, True, 0.9, "merge", None), ("t", "u", 2, 3, 0.8, True, 0.7, "remove", "a"), ("v", "w", 4, 5, 0.8, False, 0.7, "merge", "a")]
    judged = spark.createDataFrame(rows, "a string, b string, a_ord long, b_ord long, similarity double, is_same boolean, confidence double, action string, best_source string")
    judged = judged.withColumns({"a_name": F.upper("a"), "b_name": F.upper("b"), "reason": F.lit("why")})
    told = {r.decision_no: r for r in g.decisions(judged).collect()}
    assert told[1].affected_nodes == ["q", "p"] and told[1].affected_names == ["Q", "P"] and told[1].reason == "why"
    assert told[3].affected_nodes == ["t", "u"] and told[3].reason == "不同概念，各自保留。相似度 0.80，why"
    got = by_hand(g.decisions(judged).select("decision_id", "result_node", "confidence").fillna("-"))
    assert got == [("keep_0003", "-", 0.7), ("keep_0004", "-", 0.7), ("merge_0001", "q", 0.8), ("merge_0002", "r", 0.8)]


def decided(spark, rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "decision_no long, action string, affected_nodes array<string>, result_node string")


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, definition string, importance_level string")


def test_kept_nodes_in_both_modes(spark):
    d = decided(spark, [("merge", ["a", "b"], "a"), ("keep", ["c", "d"], None), ("keep", ["b", "d"], None)])
    n = nodes(spark, [(x, "", "重要") for x in "abcde"])
    assert by_hand(g.kept_nodes(n, d, intent=False).select("id")) == [("a",), ("e",)]
    assert by_hand(g.kept_nodes(n, d).select("id")) == [("a",), ("c",), ("d",), ("e",)]


def test_edges_move_one_hop_and_keep_loops(spark):
    d = decided(spark, [("merge", ["a", "b"], "a"), ("merge", ["c", "b"], "c")])
    e = spark.createDataFrame([("b", "x", "contains", "1", 1), ("c", "x", "contains", "2", 2), ("b", "c", "parallel", "3", 3), ("x", "gone", "parallel", "4", 4)], "source string, target string, relation_type string, description string, ord long")
    assert by_hand(g.merged_edges(e, d, nodes(spark, [(x, "", "") for x in "acx"]))) == [("c", "c", "parallel", "3"), ("c", "x", "contains", "1")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["关键", "重要", "补充"]), st.integers(0, 160)), min_size=1, max_size=14), st.sampled_from([0.1, 0.3, 0.8]))
def test_budget_is_met_with_the_fewest_removals(spark, items, target):
    rows = [(f"n{i:02}", "x" * n, level) for i, (level, n) in enumerate(items)]
    total = max(1, sum(n for _, n in items))
    left = [(i, d, v) for i, d, v in rows if v != "补充"]
    over = lambda part: sum(len(d) for _, d, _ in part) / total > target
    if over(left):
        left = [(i, d[:97] + "..." if v == "重要" and len(d) > 100 else d, v) for i, d, v in left]
    while over(left) and any(v == "重要" for *_, v in left):
        left.remove(max(x for x in left if x[2] == "重要"))
    got = g.within_budget(nodes(spark, rows), total, target)
    assert by_hand(got.select("id", "definition")) == sorted((i, d) for i, d, _ in left)


def test_running_totals(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(500)], "i int, x int")
    got = {r.i: (r.before, r.n) for r in running(rows, [F.col("i")], F.col("x"), number="n").collect()}
    sums = [0, *itertools.accumulate(i % 7 for i in range(499))]
    assert got == {i: (float(sums[i]), i) for i in range(500)}
    assert running(rows.limit(0), [F.col("i")], F.col("x"), number="n").count() == 0


def test_last_known_over_partitions(spark):
    rows = spark.createDataFrame([("a", i) for i in range(2000)] + [("b", i) for i in range(50)] + [("c", 7)], "g string, i int")
    got = {(r.g, r.i): r.last for r in last_known(rows, "g", "i", F.when((F.col("g") == "a") & F.col("i").isin(3, 1500), F.col("i")), to="last").collect()}
    assert got == {(g, i): (None if g != "a" or i < 3 else 3 if i < 1500 else 1500) for g, i in got} and len(got) == 2051


def test_domains_report_overrides_and_json(spark):
    n = spark.createDataFrame([(f"n{i}", f"c{i}", "极限论第一章" if i < 7 else "Introduction", i, "b", "", "重要", 1) for i in range(8)], "id string, name string, chapter string, ord long, textbook_id string, definition string, importance_level string, page int")
    cov = g.domain_coverage(n)
    assert by_hand(cov) == [("Introd", 1, "c7"), ("极限论", 7, "c0, c1, c2, c3, c4...")]
    d = decided(spark, [("merge", ["n0", "n1"], "n0")]).withColumns({"decision_id": F.lit("merge_0001"), "affected_names": F.array(F.lit("c0"), F.lit("c1")), "confidence": F.lit(0.875), "reason": F.lit("same")})
    text = g.report(g.stats(n, n, d), cov, d, g.completeness(n, n, d), generated_at="2026-01-02 03:04").first()[0]
    assert "### 案例 1：合并 — c0, c1" in text and "| 极限论 | 7 | c0, c1, c2, c3, c4... |\n| Introd | 1 | c7 |" in text and "**置信度**: 0.88" in text and "**理由**: same" in text and "生成时间：2026-01-02 03:04" in text and "保留 0 / 0" in text
    assert "（无合并案例）" in g.report(g.stats(n, n, d.limit(0)), cov, d.limit(0), g.completeness(n, n, d)).first()[0]
    o = spark.createDataFrame([("merge_0001", "keep", None)], "decision_id string, action string, result_node string")
    assert by_hand(g.overridden(d, o).select("action")) == [("keep",)]
    e = spark.createDataFrame([("b", "n0", "n1", "contains", "")], "textbook_id string, source string, target string, relation_type string, description string")
    got = g.graph_rows(n, e).collect()
    assert len(got) == 9 and [r.json for r in got if r.kind == "edge"] == ['{"source":"n0","target":"n1","relation_type":"contains","description":""}']


def test_every_node_that_goes_has_a_decision(spark):
    rows = [("s2", "B", "x" * 10, "补充"), ("s1", "A", None, "补充"), ("c", "C", "y" * 50, "关键"), *[(f"i{k}", f"N{k}", "z" * 150, "重要") for k in range(6)]]
    kept = spark.createDataFrame(rows, "id string, name string, definition string, importance_level string")
    final, told = g.budget(kept, 1000, 7)
    got = {r.decision_id: r for r in told.collect()}
    # 50 + 900 of 1,000 are over, so are 50 + 600; three important ones go until 50 + 200 are left
    assert sorted(got) == ["compress_important_0009", "purge_supp_0007", "purge_supp_0008", "trim_important_0010", "trim_important_0011", "trim_important_0012", "trim_important_0013"]
    assert got["purge_supp_0007"].affected_nodes == ["s1"] and got["purge_supp_0008"].affected_names == ["B"]
    assert got["compress_important_0009"].action == "merge" and got["compress_important_0009"].affected_nodes == [f"i{k}" for k in range(5)] and got["compress_important_0009"].result_node is None
    assert [got[f"trim_important_{k:04}"].affected_nodes[0] for k in range(10, 14)] == ["i5", "i4", "i3", "i2"] and got["trim_important_0010"].confidence == 0.85
    assert by_hand(final.select("id", F.length("definition"))) == [("c", 50), ("i0", 100), ("i1", 100)]
    n = kept.withColumn("textbook_id", F.lit("b"))
    for intent, merges in ((True, 0), (False, 1)):
        s = g.stats(n, final, told, intent).first()
        assert (s.total_decisions, s.merge_count, s.keep_count, s.remove_count, s.merged_nodes) == (7, merges, 0, 6, 3)
    final, told = g.budget(kept, 10**6)
    assert told.count() == 2 and final.count() == 7


def test_answers_of_a_judge(spark):
    answers = ['so: {"is_same": true, "confidence": 0.95, "action": "merge", "best_source": "b", "reason": "r"} done', "no idea", '{"is_same": true', '{"action": "remove", "is_same": 1}', '{"action": "join", "is_same": true}', '{"action": "merge", "is_same": true, "confidence": 1.5}', '{"is_same": true, "action": "merge"}', None]
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}", i, i + 100, 0.9, "x", "y", t) for i, t in enumerate(answers)], "a string, b string, a_ord long, b_ord long, similarity double, a_name string, b_name string, raw string")
    got = {r.a: r for r in g.parsed_judgements(pairs).collect()}
    assert (got["a0"].is_same, got["a0"].confidence, got["a0"].action, got["a0"].best_source, got["a0"].reason) == (True, 0.95, "merge", "b", "r")
    assert all((got[a].action, got[a].confidence, got[a].is_same) == ("keep", 0.5, False) and got[a].reason for a in ("a1", "a2", "a4", "a5", "a7"))
    assert got["a3"].action == "remove" and got["a3"].is_same and got["a6"].confidence == 0.5 and got["a6"].best_source == "a"
    d = {r.affected_nodes[0][1:]: r for r in g.decisions(g.parsed_judgements(pairs)).collect()}
    assert d["0"].result_node == "b0" and d["3"].action == "keep" and d["6"].result_node == "a6"
    nodes_ = spark.createDataFrame([("a0", "N", None, "t")], "id string, name string, definition string, textbook_id string")
    asked = g.judge_prompts(pairs.where("a = 'a0'").drop("a_name", "b_name", "raw").withColumn("b", F.lit("a0")), nodes_).first()
    assert asked.prompt == '{"node_a":{"name":"N","definition":null,"textbook":"t"},"node_b":{"name":"N","definition":null,"textbook":"t"},"similarity":0.9}'


def without_vectors(spark, small, monkeypatch, name):
    """The query's rows; no frame that it checkpoints row by row may have the vectors, which only the pair join needs."""
    from lexforge.operators import prefix
    from lexforge.plans import reference
    from lexforge.session import cut

    def watched(frame):
        assert "embedding" not in frame.columns
        return cut(frame)

    for module in (g, prefix, reference):
        monkeypatch.setattr(module, "cut", watched, raising=False)
    return reference.QUERIES[name](spark, small)


def test_budget_trim_writes_no_vectors(spark, small, monkeypatch):
    assert without_vectors(spark, small, monkeypatch, "budget_trim").columns == ["id", "n_chars"]


@pytest.mark.parametrize("name", ["integration_report", "integration_stats_observed", "judge_decisions", "kept_nodes_observed", "merged_edges", "integration_decisions", "integration_stats", "kept_nodes_intent"])
def test_no_vectors_are_written_after_the_pairs(spark, small, monkeypatch, name):
    assert "embedding" not in without_vectors(spark, small, monkeypatch, name).columns


class Measured(Exception):
    pass


@pytest.mark.parametrize("name", ["integration_report", "merged_edges", "integration_stats_observed", "judge_decisions", "kept_nodes_observed", "integration_decisions", "integration_stats", "kept_nodes_intent"])
def test_a_task_of_the_pair_join_needs_little_memory(spark, monkeypatch, name):
    """Two blocks in double precision with all that led to them didn't fit an executor at 1 GB."""
    from lexforge.operators import similarity
    from lexforge.plans import reference

    monkeypatch.setattr(similarity, "STRIPE", 128)
    monkeypatch.setattr(similarity, "TILE", (64, 64))
    blocks, cut, frames = [], similarity.cut, type(spark.range(1))
    monkeypatch.setattr(similarity, "cut", lambda frame: blocks.append(cut(frame)) or blocks[-1])
    then = frames.mapInArrow

    def watched(frame, task, kind, *more):
        if not kind.startswith("a "):
            return then(frame, task, kind, *more)
        body = blocks[-1].first().body
        held = sum(x.nbytes for x in pa.ipc.open_stream(body).read_all()["embedding"].chunks)
        batch = pa.RecordBatch.from_pydict({"l": [0], "r": [1], "left": [body], "right": [bytes(body)]})
        tracemalloc.start()
        try:
            list(task(iter([batch])))
            raise Measured(tracemalloc.get_traced_memory()[1] / (2 * held))
        finally:
            tracemalloc.stop()

    monkeypatch.setattr(frames, "mapInArrow", watched)
    with pytest.raises(Measured) as found:
        reference.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert found.value.args[0] < 2


@pytest.mark.parametrize("name", ["integration_stats_observed", "judge_decisions", "kept_nodes_observed", "merged_edges", "integration_decisions", "integration_stats", "kept_nodes_intent"])
def test_nodes_are_not_written_with_their_vectors(spark, small, monkeypatch, name):
    """All nodes used to be moved and written with their vectors before the pair join, which writes the vectors too."""
    from lexforge.plans import reference
    from lexforge.session import keep

    def watched(frame):
        assert "embedding" not in frame.columns
        return keep(frame)

    monkeypatch.setattr(reference, "keep", watched)
    assert "embedding" not in reference.QUERIES[name](spark, small).columns


@pytest.mark.parametrize("name", ["judge_decisions", "kept_nodes_observed", "integration_decisions", "integration_stats", "kept_nodes_intent"])
def test_pairs_are_numbered_before_they_get_names(spark, small, monkeypatch, name):
    """Pairs with names, action and reason used to be moved, written row by row and moved again to be numbered; with many pairs that filled the disk."""
    from lexforge.operators import prefix
    from lexforge.plans import reference
    from lexforge.session import cut, keep

    numbered = []

    def watched(write):
        def run(frame):
            assert "a_name" not in frame.columns
            numbered.extend([frame.columns] if "_at" in frame.columns and "a_ord" in frame.columns else [])
            return write(frame)

        return run

    monkeypatch.setattr(prefix, "cut", watched(cut))
    monkeypatch.setattr(prefix, "keep", watched(keep), raising=False)
    reference.QUERIES[name](spark, small)
    assert numbered == [["a", "b", "a_ord", "b_ord", "similarity", "_at"]]


def test_numbers_in_order(spark):
    from lexforge.operators.prefix import numbered

    rows = spark.createDataFrame([(i * 7919 % 5003, str(i)) for i in range(5000)], "i int, x string").repartition(9)
    values = sorted(i * 7919 % 5003 for i in range(5000))
    for order, want in ((F.col("i"), values), (F.desc("i"), values[::-1])):
        assert [(r.n, r.i) for r in numbered(rows, [order], "n").orderBy("n").collect()] == list(enumerate(want))
    assert numbered(rows.limit(0), [F.col("i")], "n").count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_rows_once_without_moving_all(spark, monkeypatch, most):
    """Copies of a row, of a row without key and of one without vector, a key of two different rows, and vectors that only look different."""
    from lexforge import session

    monkeypatch.setattr(session, "REPEATED", most)
    nan = float("nan")
    rows = [(1, "a", [1.0, 2.0]), (1, "a", [1.0, 2.0]), (2, "b", [0.0]), (2, "b", [-0.0]), (3, "c", [nan]), (3, "c", [nan]), (4, "d", [1.0]), (4, "d", [1.5]), (4, "e", [1.0]), (None, "f", None), (None, "f", None), (None, "g", None), (5, None, None), (6, "h", [None]), (6, "h", [None])]
    frame = spark.createDataFrame(rows, "ord long, id string, embedding array<float>")
    show = lambda f: sorted(map(str, f.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).collect()))
    got = show(session.once(frame, "ord"))
    assert got == show(frame.distinct()) and len(got) == 10
