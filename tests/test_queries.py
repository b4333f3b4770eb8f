import pytest
from eventloom.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(name, agrees):
    agrees(QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
