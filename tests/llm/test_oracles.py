"""Every query of this subpackage that has SQL, against it."""

import pytest
from conftest import SF, normal

from keyloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF), duck.sql(SQL[name])
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)
