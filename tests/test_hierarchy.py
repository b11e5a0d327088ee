import random

from conftest import by_hand

from lexforge.operators import hierarchy as h


def links(spark, pairs, extra=False):
    if extra:
        return spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "parent string, child string, node string, via int")
    return spark.createDataFrame(pairs, "parent string, child string")


def on_cycles(pairs):
    """Nodes that reach themselves, with the smallest of their part, by plain search."""
    to = {}
    for a, b in pairs:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    def reach(x):
        seen, todo = set(), list(to.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo.extend(to.get(y, ()))
        return seen
    all_ = {x: reach(x) for x in {n for p in pairs for n in p if n is not None}}
    return sorted((min(y for y in r if x in all_[y]), x) for x, r in all_.items() if x in r)


def test_tree_paths_depths_and_descendants(spark):
    got = {r.node_id: r for r in h.hierarchy(links(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("x", "y")])).collect()}
    assert got["d"].path == ["a", "b", "c", "d"] and got["d"].depth == 3 and got["d"].root_id == "a" and got["d"].parent_id == "c"
    assert got["a"].n_descendants == 4 and got["a"].parent_id is None and got["x"].n_descendants == 1
    assert all(r.cycle_id is None for r in got.values())


def test_descendants_by_distance(spark):
    assert by_hand(h.descendants(h.hierarchy(links(spark, [("a", "b"), ("b", "c")])))) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_two_parents_take_the_smallest_off_cycles(spark):
    got = {r.node_id: r for r in h.hierarchy(links(spark, [("a", "b"), ("b", "a"), ("a", "n"), ("z", "n"), ("y", "n")])).collect()}
    assert got["n"].parent_id == "y" and got["n"].n_parents == 3
    assert got["a"].cycle_id == "a" and got["b"].cycle_id == "a" and got["a"].depth == 0


def test_below_a_cycle_is_no_case(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("r", "a")]
    assert by_hand(h.cycles(links(spark, pairs))) == [("a", "a"), ("a", "b"), ("a", "c")]
    got = {r.node_id: r for r in h.hierarchy(links(spark, pairs)).collect()}
    assert got["e"].path == ["c", "d", "e"] and got["e"].cycle_id is None


def test_loops_rings_that_share_a_node_and_long_chains(spark):
    ring = [(f"n{i:03}", f"n{(i + 1) % 40:03}") for i in range(40)]
    pairs = [("s", "s"), ("p", "q"), ("q", "p"), ("q", "r"), ("r", "q"), *ring, *[(f"m{i}", f"m{i + 1}") for i in range(60)]]
    assert by_hand(h.cycles(links(spark, pairs))) == on_cycles(pairs)
    deep = {r.node_id: r.depth for r in h.hierarchy(links(spark, [(f"m{i}", f"m{i + 1}") for i in range(60)])).collect()}
    assert deep == {f"m{i}": i for i in range(61)}


def test_random_graphs_against_search(spark):
    rng = random.Random(5)
    for size in (12, 25):
        pairs = [(str(rng.randrange(size)), str(rng.randrange(size))) for _ in range(int(size * 1.3))]
        assert by_hand(h.cycles(links(spark, pairs))) == on_cycles(pairs)


def test_nulls_repeats_extra_columns_and_nothing(spark):
    pairs = [("a", "b"), ("a", "b"), (None, "c"), ("d", None)]
    assert by_hand(h.hierarchy(links(spark, pairs, extra=True)).select("node_id", "depth")) == [("a", 0), ("b", 1)]
    assert h.cycles(links(spark, [])).count() == 0 and h.hierarchy(links(spark, [])).count() == 0


def test_hot_parent(spark):
    pairs = [("hub", f"c{i}") for i in range(3000)] + [("c1", "leaf")]
    got = h.hierarchy(links(spark, pairs)).where("node_id in ('hub', 'leaf')").select("node_id", "n_descendants", "depth")
    assert by_hand(got) == [("hub", 3001, 0), ("leaf", 0, 2)]


def below_all(pairs):
    """Every ancestor and descendant over any links, by plain search."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    out = set()
    for x in {n for p in pairs for n in p}:
        seen, todo = set(), list(to.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo.extend(to.get(y, ()))
        out |= {(x, y) for y in seen if y != x}
    return out


def test_all_descendants_over_second_parents_and_through_cycles(spark):
    rng = random.Random(8)
    cases = [
        [("r", "a"), ("a", "b"), ("b", "a"), ("b", "d"), ("s", "s"), ("s", "d"), ("a", "n"), ("z", "n"), ("n", "m")],
        [(f"m{i}", f"m{i + 1}") for i in range(40)],
        [(str(rng.randrange(25)), str(rng.randrange(25))) for _ in range(32)],
    ]
    for pairs in cases:
        want = below_all(pairs)
        assert by_hand(h.all_descendants(links(spark, pairs))) == sorted(want)
        nodes = {n for p in pairs for n in p}
        assert by_hand(h.descendant_counts(links(spark, pairs))) == sorted((n, sum(a == n for a, _ in want)) for n in nodes)
    assert h.all_descendants(links(spark, [])).count() == 0 and h.descendant_counts(links(spark, [])).count() == 0


def test_all_descendants_of_the_small_tables(spark, small):
    from lexforge.plans import core

    pairs = [tuple(r) for r in core.contains_links(spark, small).collect() if r.parent is not None and r.child is not None]
    assert by_hand(core.p3_all_descendants(spark, small)) == sorted(below_all(pairs))


def test_cores_too_large_for_one_task_give_the_same(spark, monkeypatch):
    rng = random.Random(11)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [(f"c{i}", f"d{i}") for i in range(9)]
    frame = spark.createDataFrame(links, "parent string, child string")
    want = by_hand(h.cycles(frame))
    assert len(want) > 15
    monkeypatch.setattr(h, "ONE_TASK", 0)
    assert by_hand(h.cycles(frame)) == want
