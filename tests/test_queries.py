"""Every query with SQL equals it on the smallest tables; the others return rows."""

import pytest
from oracles import differences, duck

from penstroke.plans import core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_equals_sql(spark, connection, name):
    assert differences(spark, connection, core.QUERIES[name], core.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES) - {"calibrated_distances"}))
def test_returns_rows(spark, name):
    assert core.QUERIES[name](spark, SF).limit(1).count() == 1
