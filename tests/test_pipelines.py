import json

from conftest import by_hand
from pyspark.sql import functions as F

from lexforge.operators import retrieve
from lexforge.plans import pipelines as p

CH = "textbook_id string, ord int, chapter_id string, title string, page_start int, page_end int, content string"


def books(spark):
    return spark.createDataFrame([("a", "A"), ("b", "B"), ("none", "N")], "textbook_id string, title string")


def chapters(spark):
    return spark.createDataFrame([("a", 1, "ch_01", "one", 1, 4, "x" * 9000), ("a", 2, "ch_02", "two", 5, 5, "short"), ("b", 1, "ch_01", None, 1, 1, "b text"), ("none", 1, "ch_01", "t", 1, 1, "  ")], CH)


def test_extraction_from_chapters_to_graph(spark):
    def extractor():
        def model(messages):
            prompt = messages[-1]["content"]
            assert messages[0]["role"] == "system" and prompt.startswith("教材：")
            if "short" in prompt:
                return "not json"
            if "教材：B" in prompt:
                raise OSError("net")
            nodes = [{"local_id": "n1", "name": "N", "definition": "d" * len(prompt.split("起始页码：")[1].split("\n")[0])}, {"local_id": "n2", "name": "M" + prompt.split("起始页码：")[1][0]}]
            return json.dumps({"nodes": nodes, "edges": [{"source": "n1", "target": "n2", "relation_type": "contains"}]})

        return model

    batches = p.extraction_batches(chapters(spark), books(spark))
    assert by_hand(batches.select("textbook_id", "batch_no", "chapter", "page").fillna("-")) == [("a", 0, "one", 1), ("a", 1, "one", 2), ("a", 2, "one", 4), ("a", 3, "two", 5), ("b", 0, "-", 1)]
    got = p.extract(chapters(spark), books(spark), extractor, tries=2, wait=None)
    assert by_hand(got.nodes.select("id", "name", "page")) == [("a_n0001", "N", 1), ("a_n0002", "M1", 1), ("a_n0004", "M2", 2), ("a_n0006", "M4", 4)]
    assert by_hand(got.edges.select("source", "target")) == [("a_n0001", "a_n0002"), ("a_n0001", "a_n0004"), ("a_n0001", "a_n0006")]
    assert {r.textbook_id: (r.batch_count, r.failed_batches) for r in got.stats.collect()} == {"a": (4, 0), "b": (1, 1), "none": (0, 0)}
    few = p.extract(chapters(spark), books(spark), max_batches=1)
    assert few.nodes.count() == 0 and {r.textbook_id: (r.batch_count, r.total_cost_tokens) for r in few.stats.collect()} == {"a": (1, 13), "b": (1, 13), "none": (0, 0)}


def test_whole_chapters_are_asked_again_once(spark):
    def make():
        def model(messages):
            if messages[-1]["content"].startswith(p.STRICT):
                return json.dumps({"nodes": [{"name": "late"}]})
            return "no" if "two" in messages[-1]["content"] else json.dumps({"nodes": [{"id": "k", "name": "K"}], "edges": [{"source": "k", "target": "k"}]})

        return model

    nodes, edges = p.extract_whole(chapters(spark), books(spark), make)
    assert by_hand(nodes.select("textbook_id", "batch_no", "id", "name", "page")) == [("a", 1, "k", "K", 1), ("a", 2, "node_000", "late", 5), ("b", 1, "k", "K", 1)]
    assert edges.count() == 2


def node(i, book, v, level="重要", definition="d" * 50, name=None):
    return (i, name or i.upper(), definition, level, book, "第一章", 1, [float(x) for x in v], int(i[1:]))


NODES = "id string, name string, definition string, importance_level string, textbook_id string, chapter string, page int, embedding array<float>, ord long"


def test_integration_from_nodes_to_report(spark):
    rows = [node("n1", "a", [1, 0]), node("n2", "b", [1, 0.1], definition="d" * 60), node("n3", "b", [0, 1], "关键"), node("n4", "a", [0.1, 1], "补充", definition="d" * 900), node("n5", "c", [-1, 0])]
    edges = spark.createDataFrame([("n1", "n3", "contains", "", 1), ("n2", "n3", "contains", "x", 2), ("n4", "n3", "parallel", "", 3)], "source string, target string, relation_type string, description string, ord long")

    def judge():
        def model(messages):
            asked = json.loads(messages[-1]["content"])
            same = asked["node_a"]["name"] == "N1"
            return json.dumps({"is_same": same, "action": "merge" if same else "remove", "confidence": 0.9, "best_source": "b", "reason": f"{asked['similarity']:.2f}"})

        return model

    got = p.integrate(spark.createDataFrame(rows, NODES), edges, 2, model=judge, generated_at="now")
    told = {r.decision_id: r for r in got.decisions.collect()}
    assert told["merge_0001"].result_node == "n2" and told["merge_0001"].affected_names == ["N2", "N1"] and told["keep_0002"].affected_nodes == ["n3", "n4"]
    assert told["purge_supp_0002"].affected_nodes == ["n4"]
    assert by_hand(got.edges) == [("n2", "n3", "contains", "")]
    s = got.stats.first()
    assert (s.original_nodes, s.merged_nodes, s.merge_count, s.keep_count, s.remove_count, s.total_decisions) == (5, s.merged_nodes, 1, 1, s.remove_count, got.decisions.count())
    text = got.report.first()[0]
    assert "生成时间：now" in text and "N2, N1" in text and "保留 1 / 1" in text
    # without a model every pair is kept
    offline = p.integrate(spark.createDataFrame(rows, NODES), edges, 2)
    assert {r.action for r in offline.decisions.where("decision_id like 'keep%'").collect()} == {"keep"} and offline.decisions.where("decision_id like 'merge%'").count() == 0
    # vectors are made where there are none
    plain = spark.createDataFrame(rows, NODES).drop("embedding")
    assert p.integrate(plain, edges, 64).stats.first().original_nodes == 5


def test_index_and_answers(spark):
    index = p.build_index(chapters(spark), books(spark))
    assert index.count() == index.select("ord").distinct().count() > 10 and index.where("size(embedding) = 64").count() == index.count()
    asked = spark.createDataFrame([(1, "b text"), (2, "short")], "qid long, question string")

    def echo():
        return lambda messages: messages[-1]["content"]

    got = {r.qid: r for r in p.answer(asked, index, 64, echo, top=2).collect()}
    assert got[1].answer.startswith("参考资料：\n\n[1] 教材: B\n章节: \n页码: 第1页\n\nb text") and got[1].answer.endswith("问题：b text") and got[1].source_chunks[0] == "b text"
    assert got[2].citations[0].citation == "[A, two, 第5页]" and got[2].citations[0].relevance_score == 1.0
    assert {r.answer for r in p.answer(asked, index.limit(0), 64).collect()} == {p.NO_INDEX}
    assert "未配置" in p.answer(asked, index, 64).first().answer


def test_pages_from_marks_and_answers_by_page(spark):
    text = "[第1页]\n" + "甲" * 700 + "\n\n[第2页]\n" + "乙" * 900
    texts = spark.createDataFrame([("b", text)], "book string, text string")
    seen, meant = (by_hand(retrieve.page_chunks(texts, intent=i).select("chunk_no", "page")) for i in (False, True))
    assert [x for _, x in seen] == [1, 2, 0, 0] and [x for _, x in meant] == [1, 2, 2, 2]
    chunks = spark.createDataFrame([(0, "[第1页]\nalpha", 1, [1.0, 0.0]), (1, "beta", 1, [0.9, 0.1]), (2, "gamma", 2, [0.5, 0.5])], "ord long, text string, page int, embedding array<float>")
    q = spark.createDataFrame([(7, "q")], "qid long, question string")
    encode = lambda: (lambda ts: [[1.0, 0.0] for _ in ts])
    ok = p.page_answers(q, chunks, 2, lambda: (lambda m: m[-1]["content"]), encode).first()
    assert ok.answer == "参考资料：\n\n[1] (第1页)\nalpha\n\n---\n\n[2] (第2页)\ngamma\n\n问题：q" and [c.page for c in ok.citations] == [1, 2]
    failed = p.page_answers(q, chunks, 2, lambda: (lambda m: 1 / 0), encode).first()
    assert failed.answer.startswith("模型调用失败: division by zero\n\n检索到的相关资料:\n[1] (第1页)")
    assert p.page_answers(q, chunks.limit(0), 2, None, encode).first().answer == "未找到相关内容"


def test_outline_to_tree_with_summaries(spark):
    toc = spark.createDataFrame([("b", 0, 1, "封面", 1), ("b", 1, 1, " C ", 1), ("b", 2, 2, "s", 2), ("b", 3, 2, "t", 4), ("e", 0, 2, "lost", 1)], "book string, ord int, level int, title string, page int")
    tree = p.mind_map(toc)
    assert by_hand(tree.select("node_id", "depth", "name")) == [("b", 0, "b"), ("b/1", 1, "C"), ("b/2", 2, "s"), ("b/3", 2, "t"), ("e", 0, "e")]
    pages = spark.createDataFrame([("b", 0, "before any section" * 5), ("b", 1, "first\n" + "x" * 60), ("b", 2, "second"), ("b", 3, "short"), ("b", 9, " ")], "book string, page_idx int, text string")

    def make():
        def model(messages):
            assert messages[-1]["content"].startswith("[0] first\nfirst\n")
            return "[0]  a summary " + "y" * 200

        return model

    got = p.enriched_tree(toc, pages, make)
    added = got.where("depth = 3").collect()
    assert [(r.parent_id, r.type, len(r.name), r.path) for r in added] == [("b/2", "总结", 120, [1, 2, 0])]
    assert p.enriched_tree(toc, pages).count() == tree.count()
    assert p.enriched_tree(toc, pages, lambda: (lambda m: 1 / 0)).count() == tree.count()
    assert by_hand(p.section_pages(toc, pages).groupBy("sec_ord").agg(F.count("*"))) == [(2, 2), (3, 1)]
