import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from trailmark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.SQL:
        same(spark, catalog.QUERIES[name], catalog.SQL[name], SF)
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_are_pruned(spark):
    plan = catalog.QUERIES["payment_modes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "l_tax" in plan  # all columns of a line tell equal lines apart
    orders = [line for line in plan.split("\n") if "orders.parquet" in line]
    assert orders and all("o_totalprice" not in line for line in orders)
