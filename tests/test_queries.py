import importlib.util

import pytest
from compare import rows, tables

import __spark_entry__ as entry

CORE = [n for n in entry.oracle_sql() if not (n[0] == "p" and n[1].isdigit() and not n.startswith(("p3_", "p6_")))]


@pytest.mark.parametrize("name", CORE)
def test_rows_are_those_of_the_sql(spark, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    want = tables(small).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["cycle_id", "node_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_needs_nothing_of_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(importlib.util.find_spec("lexforge").origin).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"lexforge\.llm|from \.llm|import llm", path.read_text()), path
