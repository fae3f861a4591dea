"""Every registered query against its SQL counterpart."""

import pytest
from compare import connect, difference

import __spark_entry__ as driver
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.01"
NO_SQL = {
    "embed_latent",  # an iteration; compared with a full decomposition in test_latent.py
    "embed_hashed",  # hashes with murmur3; checked by brute force in test_features.py
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_the_named_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
