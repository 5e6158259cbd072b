import pytest

from foliant.plans.oracles import ORACLES, QUERIES

from .oracle import compare, duck


@pytest.fixture(scope="module")
def db(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, sf_dir, name):
    compare(spark, db, QUERIES[name], ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert frame.columns and frame.count() >= 0
