"""Every registered query of the library: against its SQL where it has one, else that it runs."""

import pytest

from tessella.plans import catalog
from tests.compare import database, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, con, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == sql_rows(con, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns
    df.collect()


def test_entry_functions():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalog.FLAGSHIP in e.queries()
