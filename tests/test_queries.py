"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from conftest import SF, normal

from keyloom import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)


def test_rows_only(spark):
    only = set(registry.queries()) - set(SQL)
    assert only == {"bf_murmur"}
    assert registry.queries()["bf_murmur"](spark, SF).count() > 100


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "member", "score", "place"]
    assert set(e.oracle_sql()) <= set(e.queries())
