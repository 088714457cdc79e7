import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trailmark.operators import ingest, registry
from trailmark.plans import catalog

SF = "/root/testdata/sf0.001"
HEAVY = ["cashout_analysis", "report_summary", "recovery_status", "layer_analysis", "mule_scores", "data_quality_summary", "key_findings", "roadmap", "leg_detail", "aggregator_accounts", "aggregator_summary", "edge_detail", "letters_diff", "lien_statuses", "earlier_sources", "repeat_accounts_replaced", "registry_orphans", "cycle_totals"]


@pytest.mark.parametrize("name", HEAVY)
def test_lines_are_read_once(spark, name):
    """What is left to be run reads the legs that were kept, and no table of the driver again."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and plan.count("o_orderkey") == 0


def test_lien_updates(spark):
    at = datetime.datetime(2024, 1, 2)
    stored = spark.createDataFrame([(1, "a", "B", "C", "pending", "x", None), (1, "b", "B", "C", "applied", None, at)], "report_id long, account_no string, bank_name string, ifsc_code string, status string, remarks string, applied_date timestamp_ntz")
    news = spark.createDataFrame([(1, "a", "applied", None), (1, "b", "success", "y"), (1, "c", None, None)], "report_id long, account_no string, status string, remarks string")
    rows = spark.createDataFrame([(1, 2, "c", "Bank", None), (1, 1, "c", " ", "CODE")], "report_id long, id long, benef_key string, beneficiary_bank string, ifsc_code string")
    now = datetime.datetime(2024, 5, 5)
    got = {r.account_no: tuple(r)[2:] for r in registry.update_liens(stored, news, rows, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {"a": ("B", "C", "applied", "x", now), "b": ("B", "C", "success", "y", at), "c": ("Bank", "CODE", "pending", None, None)}
    again = registry.update_liens(stored, spark.createDataFrame([(1, "b", "applied", None)], news.schema), rows, F.lit(now).cast("timestamp_ntz")).collect()
    assert {r.account_no: r.applied_date for r in again} == {"a": None, "b": at}
    sums = registry.lien_status_sums(spark.createDataFrame([(Decimal(30), "success"), (Decimal(60), "applied"), (Decimal(10), None)], "lien_eligible_amount decimal(18,2), status string")).first()
    assert [float(x) for x in sums] == [100, 60, 30, 0.3]


def test_ids_of_several_files(spark):
    rows = spark.createDataFrame([(f"f{f}", s, r, "A") for f in range(3) for s in range(2) for r in range(1, 4)], "path string, sheet_no int, r long, ack_no string")
    got = [r.id for r in ingest.with_ids(rows, 7, first=100).collect()]
    assert sorted(got) == list(range(101, 119))


def test_merged_columns_of_any_length(spark):
    cells = [("f", 0, "s", 0, 0, "head", 1 << 20, 1 << 14, None), ("f", 0, "s", 5, 3, "x", None, None, None), ("f", 0, "s", 7, 0, "own", None, None, None)]
    df = spark.createDataFrame(cells, "path string, sheet_no int, sheet string, r long, c long, value string, merged_to_r long, merged_to_c long, error string")
    got = {(r.r, r.c): r.value for r in ingest.fill_merged(df).collect()}
    assert got == {(0, 0): "head", (0, 3): "head", (5, 0): "head", (5, 3): "x", (7, 0): "own", (7, 3): "head"}


def test_summary_keeps_what_it_reads(spark, monkeypatch):
    """Senders of an account are not told apart for a summary that doesn't count them."""
    kept = []
    monkeypatch.setattr(catalog, "cut", lambda df: kept.append(df) or df)
    catalog.QUERIES["report_summary"](spark, SF)
    [accounts] = kept
    plan = accounts._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "beneficiary_bank" not in plan.split("Relation")[0]
