import pytest

from palimpsest.llm.queries import ORACLES, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
