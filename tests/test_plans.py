"""What the plans must look like: pruned scans, pruned ranks, no products."""

import pytest

from tidegraph import catalog
from tidegraph.operators import ranking
from tidegraph.queries import relational
from tidegraph.sources import edges as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_ranks_are_pruned_before_the_shuffle(spark):
    p = plan(relational.daily_ranking(spark, SF))
    assert "WindowGroupLimit" in p


def test_scans_read_what_is_needed(spark):
    p = plan(relational.period_sums(spark, SF))
    read = p[p.rindex("ReadSchema") :].splitlines()[0]
    assert "event_id" in read and "props" not in read.split("struct", 1)[0]
    dates = plan(ranking.trailing_sums(E.ship_transactions(spark, SF).selectExpr("date", "from_address AS from_addr", "to_address AS to_addr", "1L AS tx_count")))
    assert "l_extendedprice" not in dates[dates.rindex("== Physical Plan") :] and "l_tax" not in dates[dates.rindex("== Physical Plan") :]


@pytest.mark.parametrize("name", ["t01_restricted_edges", "w14_trailing_edges", "a32_dual_activity", "k01_daily_ranking", "v08_attribution", "a25_cramers_v"])
def test_no_products(spark, name):
    p = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
