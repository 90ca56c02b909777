"""Every registered query against its SQL on the same tables (CHECK_SF_DIR picks the scale)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(directory):
    return connect(directory)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, directory, duck, name):
    assert difference(queries()[name](spark, directory), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_runs(spark, directory, name):
    assert queries()[name](spark, directory).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "chain_name" and df.count() > 0


def test_locations_rows_match_their_sql(spark, directory, duck):
    from poiscope.sources.locations import LOCATIONS_CTE, locations

    assert difference(locations(spark, directory), duck, LOCATIONS_CTE + "SELECT * FROM locations") is None
