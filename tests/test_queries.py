import pytest

from tests.oracle import difference
from weirflow.queries import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == ""
