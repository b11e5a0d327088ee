from datetime import datetime

from conftest import by_hand

from lexforge.operators import orphans

R, P = "ref_id long, endpoint string, key string, at timestamp, period string, range_no string", "key string, at timestamp, endpoint int"
T = [datetime(2025, 1, d) for d in range(1, 10)]


def states(spark, refs, parents, **kw):
    r = spark.createDataFrame([(*x, "clash") for x in refs], R)
    p = spark.createDataFrame([(*x, 7) for x in parents], P)
    return by_hand(orphans.resolve_references(r, p, **kw).select("ref_id", "state"))


def test_known_later_missing(spark):
    refs = [(1, "s", "a", T[3], "m"), (2, "s", "b", T[3], "m"), (3, "s", "z", T[3], "m"), (4, "s", None, T[3], "m"), (5, "s", "a", None, None)]
    assert states(spark, refs, [("a", T[1]), ("a", T[8]), ("b", T[5]), (None, T[0])]) == [(1, "known"), (2, "later"), (3, "missing"), (5, "known")]


def test_many_ranges_and_split_hot_key(spark):
    parents = [(f"k{i:04}", T[0]) for i in range(500)]
    refs = [(i, "s", f"k{i % 700:04}", T[1], "m") for i in range(2000)] + [(10_000 + i, "t", "k0003", T[1], "m") for i in range(1500)]
    got = states(spark, refs, parents, keys_per_range=20, references_per_split=100)
    assert len(got) == 3500 and sum(s == "missing" for _, s in got) == sum(i % 700 >= 500 for i in range(2000))


def test_empty_tables_long_keys_and_repeats(spark):
    assert states(spark, [], [("a", T[0])]) == []
    assert states(spark, [(1, "s", "a", T[0], "m")], []) == [(1, "missing")]
    long = "x" * 5000
    assert states(spark, [(1, "s", long, T[0], "m"), (1, "s", long, T[0], "m"), (2, "s", long + "y", T[0], "m")], [(long, None)]) == [(1, "known"), (1, "known"), (2, "missing")]


def test_report_counts(spark):
    rows = spark.createDataFrame([(1, "s", "2025-01", "missing"), (2, "s", "2025-01", "known"), (3, "t", "2025-01", "later")], "ref_id long, endpoint string, period string, state string")
    assert by_hand(orphans.report(rows, "edges")) == [("edges", "s", "2025-01", 2, 1, 0), ("edges", "t", "2025-01", 1, 0, 1)]


def test_a_range_of_too_many_keys_is_cut_into_parts(spark):
    parents = [(f"k{i:04}", T[0]) for i in range(500)]
    refs = [(i, "s", f"k{i % 700:04}", T[1], "m") for i in range(2000)]
    whole = states(spark, refs, parents)
    assert states(spark, refs, parents, keys_per_range=100, keys_per_part=7, references_per_split=50) == whole
