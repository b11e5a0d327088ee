from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.operators.chunks import BATCHES, PAGES, RETRIEVAL, Rule, chunk, pieces, windows


def test_boundary_at_the_sought_place():
    strict, loose = Rule(10, 2, 0.8), Rule(10, 2, 0.8, beyond=2)
    assert list(windows("abcdefgh.jklmnop", strict)) == [(0, 10), (8, 16)]
    assert list(windows("abcdefgh.jklmnop", loose)) == [(0, 9), (7, 16)]
    assert list(windows("abcdefghi.klmnop", strict)) == [(0, 10), (8, 16)]


def test_short_texts():
    assert list(pieces(" a ", RETRIEVAL)) == [(0, "a")] and list(pieces("  ", RETRIEVAL)) == []
    assert list(pieces(" a ", BATCHES)) == [(0, " a ")]
    assert list(pieces("a" * 20, PAGES)) == [] and list(pieces("a" * 21, PAGES)) == [(0, "a" * 21)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab。.\n 中", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_windows_cover_and_go_on(text, size, overlap):
    rule = Rule(size, overlap, 0.8)
    got = list(windows(text, rule))
    assert all(b - a <= size for a, b in got)
    assert [x for a, b in zip(got, got[1:], strict=False) for x in (b[0] > a[0], b[0] == a[1] - overlap)].count(False) == 0
    covered = set().union(*(range(a, b) for a, b in got)) if got else set()
    assert covered == set(range(len(text)))


def test_frame_with_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x。" * 700)], "doc_id long, text string")
    got = chunk(rows, "text", RETRIEVAL, ["doc_id"]).collect()
    assert {r.doc_id for r in got} == {3} and got[0].n_chunks == len(got)
