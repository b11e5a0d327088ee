import pytest
from compare import rows, tables

from lexforge.llm import queries

COLUMNS = {
    "p1_found": ["first_id", "best_id"], "p2_found": ["textbook_id", "ord", "line_no"], "p4_found": ["textbook_id", "ord", "line_no", "kind"],
    "p5_found": ["group_id", "node_id"], "p7_found": ["id_a", "id_b"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_the_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    want = tables(small).execute(queries.SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs_and_found_ones_are_distinct(spark, small, name):
    got = queries.QUERIES[name](spark, small)
    if name in COLUMNS:
        assert got.columns == COLUMNS[name]
        assert got.count() == got.distinct().count()
    assert len(got.columns) and got.count() >= 0
