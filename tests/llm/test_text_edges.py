import pytest

from tests.conftest import DATA
from tests.test_edges import dirty, empty, pytestmark  # noqa: F401
from tidemark.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["p7_found", "p8_found", "p8_mix", "p9_found"])
def test_dirty_rows_change_nothing(spark, rows, dirty, name):  # noqa: F811
    fn = QUERIES[name][0]
    assert rows(fn(spark, dirty)) == rows(fn(spark, DATA))
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):  # noqa: F811
    n = QUERIES[name][0](spark, empty).count()
    spark.catalog.clearCache()
    assert n == 0
