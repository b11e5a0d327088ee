import numpy as np
import pyarrow as pa
from conftest import by_hand

from lexforge.operators import similarity as s


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 40)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((150, 8))
    v[7] = 0
    rows = [(f"n{i}", f"b{i % 3}", i, [float(x) for x in v[i]] if i != 9 else None) for i in range(150)]
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want = sorted((f"n{i}", f"n{j}") for i in range(150) for j in range(i + 1, 150) if i % 3 != j % 3 and 9 not in (i, j) and 7 not in (i, j) and u[i] @ u[j] >= 0.6)
    got = s.candidate_pairs(spark.createDataFrame(rows, "id string, book string, ord long, embedding array<double>"), 8, 0.6)
    assert by_hand(got.select("a", "b")) == want


def test_best_per_key_is_taken_inside_the_window(spark):
    found = spark.createDataFrame([(0, 1, "A", 0.9), (0, 2, "A", 0.8), (0, 3, "B", 0.7)], "qid int, ord int, key string, score double")
    assert by_hand(s.best_per_key(found, 2).select("key", "score")) == [("A", 0.9), ("B", 0.7)]
    assert by_hand(s.best_per_key(found.where("score > 0.75"), 2).select("key")) == [("A",)]


def test_top_rows_and_contexts(spark):
    from lexforge.operators.retrieve import answer_contexts

    rows = [(i, "k", "text %d" % i, "book", f"c{i % 2}", i, [1.0, i / 10]) for i in range(6)]
    chunks = spark.createDataFrame(rows, "ord long, key string, text string, textbook_name string, chapter_title string, page_start int, embedding array<float>")
    q = spark.createDataFrame([(5, [1.0, 0.0]), (6, None)], "qid long, embedding array<float>")
    assert by_hand(s.top_per_question(q, chunks, 2, 2).select("qid", "ord")) == [(5, 0), (5, 1)]
    got = answer_contexts(q, chunks, 2, 2).first()
    assert got.context == "[1] text 0\n\n---\n\n[2] text 1" and got.citations[0].citation == "[book, c0, 第0页]"


def test_pairs_of_many_cells_and_blocks_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 30)
    monkeypatch.setattr(s, "PER_PIVOT", 20)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((25, 12))[rng.integers(0, 25, 600)] + 0.1 * rng.standard_normal((600, 12))
    v[:200] = v[0] + 0.01 * rng.standard_normal((200, 12))
    rows = [(f"n{i}", f"b{i % 4}", i, [float(x) for x in v[i]]) for i in range(600)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for least in (0.9, 0.2, -0.5):
        want = sorted((f"n{i}", f"n{j}") for i, j in zip(*np.nonzero(np.triu(u @ u.T >= least, 1)), strict=True) if i % 4 != j % 4)
        got = by_hand(s.candidate_pairs(spark.createDataFrame(rows, "id string, book string, ord long, embedding array<double>"), 12, least).select("a", "b"))
        assert got == want


def test_any_number_of_questions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 6))
    chunks = spark.createDataFrame([(i, i % 7, [float(x) for x in v[i]]) for i in range(300)], "ord long, key int, embedding array<double>")
    q = chunks.where("ord < 90").select(chunks.ord.alias("qid"), "embedding")
    want = by_hand(s.top_per_question(q, chunks, 6, 4).select("qid", "ord"))
    monkeypatch.setattr(s, "QUESTIONS", 40)
    monkeypatch.setattr(s, "CHUNKS", 70)
    assert by_hand(s.top_per_question(q, chunks, 6, 4).select("qid", "ord")) == want and len(want) == 360
    assert s.top_per_question(q, chunks.limit(0), 6, 4).count() == 0


def test_every_row_is_stored_once_for_the_pair_join(spark, monkeypatch):
    """Rows used to be copied to every cell that could hold a partner: with vectors without structure, to all."""
    monkeypatch.setattr(s, "BLOCK", 100)
    monkeypatch.setattr(s, "PER_PIVOT", 20)
    rng = np.random.default_rng(9)
    rows = [(f"n{i}", f"b{i % 4}", i, [float(x) for x in rng.standard_normal(16)]) for i in range(400)]
    seen = []
    cut = s.cut
    monkeypatch.setattr(s, "cut", lambda frame: seen.append(cut(frame)) or seen[-1])
    s.candidate_pairs(spark.createDataFrame(rows, "id string, book string, ord long, embedding array<float>"), 16, 0.3)
    (blocks,) = seen
    held = [pa.ipc.open_stream(r.body).read_all()["ord"].to_pylist() for r in blocks.collect()]
    assert sorted(x for part in held for x in part) == list(range(400)) and max(map(len, held)) < 200


def test_pairs_are_found_from_few_components(spark):
    """Every component of every pair used to be multiplied; most pairs are told apart by some of them and a bound on the rest."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((700, 12)) @ rng.standard_normal((12, 32)) + 0.4 * rng.standard_normal((700, 32))
    v[601:] = v[:99] + 0.3 * rng.standard_normal((99, 32))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert s._basis(u, 32, 0.8)[1] < 32
    assert s._basis(u[:0], 32, 0.8)[1] == s._basis(u[:1], 32, 0.8)[1] == 32
    rows = [(f"n{i}", f"b{i % 3}", i, [float(x) for x in v[i]]) for i in range(700)]
    want = sorted((f"n{i}", f"n{j}") for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.8, 1)), strict=True) if i % 3 != j % 3)
    got = s.candidate_pairs(spark.createDataFrame(rows, "id string, book string, ord long, embedding array<double>"), 32, 0.8)
    assert by_hand(got.select("a", "b")) == want and len(want) > 50
