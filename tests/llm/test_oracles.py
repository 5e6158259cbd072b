import pytest

from foliant.llm.oracles import ORACLES
from foliant.llm.queries import QUERIES

from ..oracle import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, duck(sf_dir), QUERIES[name], ORACLES[name], sf_dir)
