"""Every registered query of the library against its SQL twin, on the smallest tables."""

import pytest

from falloff.plans import catalogue
from oracle import spark_rows, sql_rows, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_rows(catalogue.QUERIES[name](spark, SF))
    assert rows or name in ("plan_warnings",)
    if name in catalogue.ORACLE_SQL:
        expected_columns, expected = sql_rows(con, catalogue.ORACLE_SQL[name])
        assert columns == expected_columns
        assert len(rows) == len(expected)
        assert [(a, b) for a, b in zip(rows, expected, strict=True) if a != b][:3] == []


def test_only_similarity_lacks_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) <= {"fuzzy_match", "fuzzy_fallback"}


def test_entry_point():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
