"""Every registered query of the network engine against its SQL, on the smallest tables; those without SQL must give rows, without a NaN."""

import pytest

from tests.compare import connect, difference
from tidegraph import catalog

SF = "/root/testdata/sf0.001"
#: Graphs of these tables are too small for communities.
NONE_HERE = {"c09_community_bands"}
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    if name in ORACLES:
        assert difference(df, ORACLES[name], duck) == ""
    else:
        rows = df.collect()
        assert (rows or name in NONE_HERE) and len(set(df.columns)) == len(df.columns)
        assert all(x is None or x == x for r in rows for x in r if isinstance(x, float))  # missing is NULL, never NaN
        assert not rows or any(x is not None for r in rows for x in r[1:])


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
