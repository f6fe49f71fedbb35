"""Every registered plan against its SQL twin on the smallest tables."""

import pytest
from oracle import compare, connect

from cuegrain.plans.all import ORACLES, PLANS


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan(spark, small, con, name):
    df = PLANS[name](spark, small)
    if name in ORACLES:
        compare(df, con, ORACLES[name])
    else:
        assert df.count() >= 0
