import numpy as np
from conftest import by_hand
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.llm import packing as p
from lexforge.llm import tokens


def items(spark, sizes):
    return spark.createDataFrame([(i, n, "clash", 1) for i, n in enumerate(sizes)], "doc_id long, n_tokens long, container_id string, piece_no int")


def check(rows, sizes, capacity):
    """Every token once and in order, nothing over capacity, nothing divided that fits."""
    parts, room = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
    assert max(room.values()) <= capacity
    want = {i: n for i, n in enumerate(sizes) if n}
    assert set(parts) == set(want)
    for i, n in want.items():
        at = 0
        for start, size in sorted(parts[i]):
            assert start == at
            at += size
        assert at == n and (n > capacity or len(parts[i]) == 1)
    return len(room)


def test_little_room_is_left(spark):
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5.5, 1.1, 4000).astype(int) + 1, 30_000).tolist()
    for capacity in (512, 4096):
        rows = p.pack(items(spark, sizes), capacity).collect()
        assert check(rows, sizes, capacity) <= 1.02 * -(-sum(sizes) // capacity) + 2


def test_nulls_zeros_ties_exact_fits_and_nothing(spark):
    sizes = [None, 0, 10, 10, 20, 5, 25, 40]
    rows = p.pack(items(spark, sizes), 10).collect()
    check(rows, sizes, 10)
    assert p.pack(items(spark, []), 10).count() == 0
    assert p.pack(items(spark, [20, 10]), 10).count() == 3


def test_hot_length_is_ranked_in_splits(spark, monkeypatch):
    monkeypatch.setattr(p, "RANKED", 50)
    sizes = [7] * 1000 + [3] * 1000
    rows = p.pack(items(spark, sizes), 10).collect()
    assert check(rows, sizes, 10) == 1000


def best_padding(lengths, counts, buckets):
    m = len(lengths)
    cost = lambda i, j: sum(c * (lengths[j - 1] - x) for x, c in zip(lengths[i:j], counts[i:j], strict=True))
    best = {(0, 0): 0}
    for k in range(1, buckets + 1):
        for j in range(m + 1):
            options = [best[k - 1, i] + (cost(i, j) if j > i else 0) for i in range(j + 1) if (k - 1, i) in best]
            if options:
                best[k, j] = min(options)
    return best[buckets, m]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=14), st.integers(1, 6))
def test_boundaries_are_the_best_ones(hist, buckets):
    lengths, counts = (np.array(x) for x in zip(*sorted(hist.items()), strict=True))
    bounds = p.boundaries(lengths, counts, buckets)
    assert len(bounds) <= max(buckets, 1) or len(lengths) <= buckets
    padding = sum(c * (bounds[np.searchsorted(bounds, x)] - x) for x, c in zip(lengths, counts, strict=True))
    assert padding == best_padding(lengths.tolist(), counts.tolist(), buckets)


def test_tokens(spark):
    text = "This is 第 1 章 😀\n\nof it's <|endoftext|> text."
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "中" * 5000)], "doc_id long, text string")
    enc = tokens.encoding(tokens.VOCABULARY)
    got = by_hand(tokens.count_tokens(rows))
    assert got == [(1, len(enc.encode_ordinary(text))), (2, 0), (3, 0), (4, len(enc.encode_ordinary("中" * 5000)))]
    assert enc.decode(enc.encode_ordinary(text)) == text


def test_report(spark):
    got = p.fill_report(p.pack(items(spark, [5, 5, 5]), 10), 10).select("containers", F.col("unused_share"))
    assert by_hand(got) == [(2, 0.25)]
