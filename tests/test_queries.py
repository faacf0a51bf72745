"""Every query with SQL against DuckDB, and the others for rows."""

import pytest

from tabloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same):
    assert same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(name, spark):
    from tests.conftest import DATA

    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    made = entry.entry(spark)
    assert made.columns == ["lang", "source", "n_chars", "quality", "toxic"] and made.count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
