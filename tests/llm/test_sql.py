"""The queries that have SQL, against it."""

import pytest

from tessella.llm.queries import ORACLE, QUERIES
from tests.compare import database, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(database(SF), ORACLE[name])
