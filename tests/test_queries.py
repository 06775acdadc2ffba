import pytest
from conftest import TESTDATA
from oracle import assert_same, connect

from tidegauge.plans import registry

SMALL = TESTDATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SMALL))
    if name in registry.ORACLES:
        assert_same(df, duck, registry.ORACLES[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
