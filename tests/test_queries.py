"""Every query of the star-schema engine against its SQL in a second engine."""

import pytest

from astrolabe.plans import catalogue
from compare import connect, differences

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module")
def larger():
    return connect(MIDDLE)


@pytest.mark.parametrize("key", sorted(catalogue.QUERIES))
def test_small(spark, con, key):
    assert not differences(catalogue.QUERIES[key](spark, SMALL), con, catalogue.ORACLES[key])


@pytest.mark.parametrize("key", [k for k in sorted(catalogue.QUERIES) if k.startswith("ssb_")])
def test_benchmark_middle(spark, larger, key):
    assert not differences(catalogue.QUERIES[key](spark, MIDDLE), larger, catalogue.ORACLES[key])


def test_every_query_has_an_oracle():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()
