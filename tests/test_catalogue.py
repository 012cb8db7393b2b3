import pytest

from corpusmill.plans import catalogue, stage_queries  # noqa: F401  registers its queries
from tests.compare import SF, assert_same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_rows_equal_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name])
