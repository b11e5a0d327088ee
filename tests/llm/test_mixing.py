import random

import pytest
from conftest import by_hand
from pyspark.sql import functions as F

from lexforge.llm import mixing as m

DOCS = "doc_id long, source string, n_tokens long, mix string, cap int"
TARGETS = "mix string, source string, target_share double, max_repeats int, copies int"


def run(spark, docs, targets):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], DOCS)
    t = spark.createDataFrame([(*x, 1) for x in targets], TARGETS)
    drawn = m.mix(d, t)
    return drawn, {(r.mix, r.source): r for r in m.shares(drawn, t).collect()}


def docs():
    rng = random.Random(1)
    return [(i, ["big", "Mid ", "tiny-one"][0 if i % 10 else 1 if i % 20 else 2], int(rng.lognormvariate(5, 1)) + 1) for i in range(4000)]


def test_shares_and_caps(spark):
    drawn, got = run(spark, docs(), [("x", "big", 0.5, 1), ("x", "mid", 0.3, 3), ("x", "tiny_one", 0.2, 4)])
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in got.values())
    assert all(r.most_copies <= r.max_repeats for r in got.values())
    held = {}
    for _, s, n in docs():
        held[s.strip().lower().replace("-", "_")] = held.get(s.strip().lower().replace("-", "_"), 0) + n
    # the total is as large as the caps allow: one source is used up
    assert max(r.tokens / (r.max_repeats * held[r.source]) for r in got.values()) > 0.99
    assert drawn.count() == drawn.select("doc_id").distinct().count()


def test_sources_that_hold_nothing_leave_their_share_to_the_others(spark):
    _, got = run(spark, docs(), [("x", "big", 0.6, 2), ("x", "tiny_one", 0.2, 5), ("x", "none", 0.2, 5)])
    assert got["x", "none"].tokens == 0
    assert abs(got["x", "big"].actual_share - 0.75) < 0.01 and abs(got["x", "tiny_one"].actual_share - 0.25) < 0.01


def test_same_run_twice_and_two_mixes(spark):
    t = [("x", "big", 0.5, 2), ("x", "mid", 0.5, 2), ("y", "big", 0.1, 1), ("y", "mid", 0.9, 1)]
    assert by_hand(run(spark, docs(), t)[0]) == by_hand(run(spark, docs(), t)[0])


def test_nulls_zero_sizes_odd_targets_and_nothing(spark):
    rows = [(1, None, 5), (2, "a", None), (3, "a", 0), (4, "a", 7), (5, "b", 7)]
    drawn, got = run(spark, rows, [("x", "a", 0.5, 1), ("x", "b", 0.5, None), ("x", None, 0.1, 1), (None, "a", 1.0, 1), ("y", "a", None, 2)])
    assert by_hand(drawn.select("mix", "doc_id", "copies")) == [("x", 4, 1)]
    assert run(spark, [], [("x", "a", 1.0, 1)])[0].count() == 0
    assert run(spark, rows, [])[0].count() == 0


def test_hot_source(spark):
    rows = [(i, "hot", 100) for i in range(9000)] + [(i, "cold", 100) for i in range(9000, 9100)]
    _, got = run(spark, rows, [("x", "hot", 0.9, 1), ("x", "cold", 0.1, 2)])
    assert abs(got["x", "hot"].actual_share - 0.9) < 0.005


def test_multipliers_that_are_not_found_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(m, "STEPS", 1)
    with pytest.raises(RuntimeError, match="no multiplier"):
        run(spark, docs(), [("x", "big", 0.5, 1), ("x", "mid", 0.3, 3), ("x", "tiny_one", 0.2, 4)])


def test_rounding_comes_as_near_as_the_documents_allow(spark):
    drawn, got = run(spark, docs(), [("x", "big", 0.5, 2), ("x", "mid", 0.3, 3), ("x", "tiny_one", 0.2, 4)])
    whole = sum(r.tokens for r in got.values())
    largest = {r.source: r.n for r in drawn.groupBy("source").agg(F.max("n_tokens").alias("n")).collect()}
    assert all(abs(r.tokens - r.target_share * whole) <= largest[r.source] for r in got.values())
