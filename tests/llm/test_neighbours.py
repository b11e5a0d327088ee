import numpy as np
import pytest

from lexforge.llm import neighbours as n

SCHEMA = "id string, embedding array<float>, asks string, list_no int, other string"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "clash", 1, "clash") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 32))
    v = centres[rng.integers(0, 60, 3000)] + 0.25 * rng.standard_normal((3000, 32))
    return v * rng.uniform(0.3, 9, (3000, 1))


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_all_pairs_above_a_bound(spark, cloud):
    u = unit(cloud)
    s = np.triu(u @ u.T, 1)
    want = {(f"{a:04}", f"{b:04}") for a, b in zip(*np.nonzero(s >= 0.97), strict=True)}
    got = {tuple(sorted((r.id, r.other))) for r in n.search(frame(spark, [f"{i:04}" for i in range(3000)], cloud), 32, least=0.97, probes=4).collect()}
    assert got <= {(f"{a:04}", f"{b:04}") for a, b in zip(*np.nonzero(s >= 0.97 - 1e-4), strict=True)}
    assert len(got & want) >= 0.99 * len(want)


def test_recall_of_the_k_nearest(spark, cloud):
    u = unit(cloud)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in n.search(frame(spark, [f"{i:04}" for i in range(3000)], cloud), 32, k=5, probes=4, asks="int(id) % 20 = 0").collect():
        got.setdefault(int(r.id), set()).add(int(r.other))
    assert set(got) == set(range(0, 3000, 20)) and all(len(x) == 5 for x in got.values())
    hits = sum(len(got[i] & set(np.argsort(-s[i])[:5].tolist())) for i in got)
    assert hits >= 0.9 * 5 * len(got)


def test_unusable_vectors_repeats_ties_and_nothing(spark):
    ids = ["a", "b", "c", "d", "e", "f", "a", None, "g"]
    vectors = [[1, 0], [2, 0], None, [0, 0], [1, 0, 0], [float("nan"), 1], [1, 0], [1, 0], [3, 0]]
    got = sorted((r.id, r.other) for r in n.search(frame(spark, ids, vectors), 2, least=0.9).collect())
    assert got == [("a", "b"), ("a", "g"), ("b", "a"), ("b", "g"), ("g", "a"), ("g", "b")]
    assert sorted((r.id, r.other) for r in n.search(frame(spark, ids, vectors), 2, k=1).collect()) == [("a", "b"), ("b", "a"), ("g", "a")]
    assert n.search(frame(spark, [], []), 2, k=1).count() == 0
    with pytest.raises(ValueError, match="either"):
        n.search(frame(spark, [], []), 2)


def test_a_hot_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 50)
    rng = np.random.default_rng(4)
    v = np.concatenate([np.tile(rng.standard_normal(16), (200, 1)) + 0.01 * rng.standard_normal((200, 16)), rng.standard_normal((400, 16))])
    rows = frame(spark, [f"{i:03}" for i in range(600)], v)
    index = n.fit(rows, 16, list_size=60)
    assert index.sizes.max() > 2 * n.BLOCK
    pairs = {tuple(sorted((r.id, r.other))) for r in n.search(rows, 16, least=0.99, probes=4, index=index).collect()}
    assert sum(int(a) < 200 and int(b) < 200 for a, b in pairs) == 200 * 199 // 2


def test_scan_keeps_what_a_full_scan_keeps():
    rng = np.random.default_rng(6)
    q, m = unit(rng.standard_normal((50, 64))).astype(np.float32), unit(rng.standard_normal((400, 64))).astype(np.float32)
    m[:50] = unit(q + 0.04 * rng.standard_normal((50, 64)).astype(np.float32))
    bound = np.full(50, 0.3, np.float32)
    i, j, d = n._scan(q, m, bound)
    full = ((q[:, None] - m[None]) ** 2).sum(2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(full <= 0.3)), strict=True))
    assert np.allclose(d, full[i, j], atol=1e-4)


def test_copies_of_a_neighbour_or_of_the_asker_take_no_places(spark):
    ids = ["a"] * 21 + ["b"] * 21 + ["c", "d", "e", "f"]
    vectors = [[1, 0]] * 21 + [[1, 0.01]] * 21 + [[1, 0.02], [1, 0.03], [1, 0.04], [0, 1]]
    got = sorted((r.id, r.other) for r in n.search(frame(spark, ids, vectors), 2, k=3, asks="id = 'a'").collect())
    assert got == [("a", "b"), ("a", "c"), ("a", "d")]


def test_the_scan_starts_at_the_first_row_and_finds_what_a_full_one_finds():
    rng = np.random.default_rng(8)
    for size in (5, 300, 2_049, 5_000):
        m = unit(rng.standard_normal((size, 64))).astype(np.float32)
        q = unit(m[:20] + 0.5 * rng.standard_normal((len(m[:20]), 64))).astype(np.float32)
        bound = n._bound(q, m, 3)
        full = ((q[:, None] - m[None]) ** 2).sum(2)
        i, j, _ = n._scan(q, m, bound)
        best = set(zip(i.tolist(), j.tolist(), strict=True))
        want = {(a, b) for a in range(len(q)) for b in np.argsort(full[a])[:3].tolist()}
        assert len(best & want) >= 0.97 * len(want)


def test_lists_to_probe_follow_the_vectors(spark):
    rng = np.random.default_rng(9)
    tight = rng.standard_normal((40, 16))[rng.integers(0, 40, 2000)] + 0.05 * rng.standard_normal((2000, 16))
    loose = rng.standard_normal((2000, 16))
    fits = [n.fit(frame(spark, [f"{i:04}" for i in range(2000)], v), 16, lists=40) for v in (tight, loose)]
    assert fits[0].probes <= 3 < fits[1].probes <= len(fits[1].centres)


def test_links_of_copies_without_their_pairs(spark):
    ids = [f"{i:03}" for i in range(60)] + ["a", "b", "b", "c", None, "z"]
    vectors = [[1, 0]] * 60 + [[1, 0.1], [2, 0.2], [2, 0.2], [0, 1], [1, 0], [0, 0]]
    members, pairs = n.linked(frame(spark, ids, vectors), 2, 0.9)
    got = {r.id: (r.class_id, r.n_links) for r in members.collect()}
    assert got == {f"{i:03}": ("000", 61) for i in range(60)} | {"a": ("a", 61), "b": ("b", 61), "c": ("c", 0)}
    assert sorted((r.class_a, r.class_b) for r in pairs.collect()) == [("000", "a"), ("000", "b"), ("a", "b")]
    assert n.linked(frame(spark, [], []), 2, 0.9)[0].count() == 0
