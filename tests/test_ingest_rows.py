"""Rows of sheets are kept once, as they are read, and know their sheet without being dealt by it."""

import os
import re

import pytest
from pyspark.sql import functions as F

from test_ingest import CASH, TRANSFER, sheets, xlsx
from trailmark.operators import ingest
from trailmark.plans import catalog
from trailmark.session import kept_dir
from trailmark.sources import workbook
from trailmark.sources.sheets import ledger_rows

SF = "/root/testdata/sf0.001"
#: Copies of all rows that a query may keep.
COPIES = {"ingest_errors": 1, "ingest_mapping": 0, "ingest_old_transactions": 1, "ingest_rows": 1, "ingest_sheets": 1, "ingest_merged_cells": 1, "ingest_header_rows": 0}


def folders(spark):
    at = kept_dir(spark).removeprefix("file:")
    return {f"{at}/{x}" for x in os.listdir(at)} if os.path.isdir(at) else set()


@pytest.mark.parametrize("name", COPIES)
def test_rows_are_kept_once(spark, name):
    before, old = folders(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.QUERIES[name](spark, SF)
        plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    n, kept = ledger_rows(spark, SF).count(), [spark.read.parquet(f).count() for f in folders(spark) - before]
    assert n > 5000 and sum(kept) <= (COPIES[name] + 0.5) * n
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert not [x for x in dealt if ("cells#" in x or "transaction_amount#" in x) and "header_r#" not in x and "matches#" not in x]


def test_reader_gives_rows_with_all_ranges_that_cover_them(spark, tmp_path):
    """The same as cells put together; rows may come in any order, and ranges may be wide, long or without a value."""
    odd = [["a", None, "b"], [None, "x", None], ["c"], [None, "d", "e"], [None, None, "f"]]
    content = xlsx({"s": odd, "t": [["z", "y"]]}, merges=["A1:B3", "C1:C5", "A4:A5", "B4:C4"])
    (tmp_path / "a.xlsx").write_bytes(content)
    (tmp_path / "b.xls").write_bytes(b"old")
    order = lambda df: sorted((r.path, r.sheet_no or 0, r.r or 0, sorted(r.cells), sorted(r.ranges), r.error or "") for r in df.collect())
    got = order(workbook.read_rows(spark, str(tmp_path)))
    assert got == order(ingest.row_form(workbook.read_workbooks(spark, str(tmp_path)))) and len(got) == 7
    assert [len(x[4]) for x in got[:5]] == [2, 2, 2, 2, 1]
    filled = {(r.sheet, r.r, r.c): r.value for r in ingest.fill_merged(workbook.read_rows(spark, str(tmp_path))).collect()}
    assert filled == {(r.sheet, r.r, r.c): r.value for r in ingest.fill_merged(workbook.read_workbooks(spark, str(tmp_path))).collect()}
    of = workbook._covering([(0, 0, 9, 0, "a"), (3, 1, 4, 1, "b")])
    assert [[m[4] for m in of(r)] for r in (0, 3, 5, 4, 10, 3)] == [["a"], ["a", "b"], ["a"], ["a", "b"], [], ["a", "b"]]


@pytest.mark.parametrize("few", [True, False])
def test_sheets_of_rows_are_looked_up_or_joined(spark, tmp_path, monkeypatch, few):
    """Beyond a bound sheets are no broadcast table; blind sheets without money and rows of old sheets come out the same."""
    if not few:
        monkeypatch.setattr(ingest, "BROADCAST_SHEETS", 0)
    old = [["Acknowledgement No", "Account No.", "Transaction Amount", "P.Trans", "P Account No"], ["A1", "OLD1", "5", "T1", "-"], ["A2", "OLD2", "5", None, "P2"]]
    more = {"Old Transaction": old, "Sheet 7": [CASH[:5], ["A1", "V1", 1, "10", "15/01/2024"]], "Sheet 8": [CASH[:5], ["A1", "V1", 1, "0", "15/01/2024"]], "Sheet 9": [CASH[:5], ["A1", None, 1, "0", "15/01/2024"]]}
    (tmp_path / "a.xlsx").write_bytes(xlsx({**sheets(), **more}))
    (tmp_path / "b.xlsx").write_bytes(xlsx({"Money Transfer to": [[h for h in TRANSFER if h != "Disputed Amount"]], "AEPS": [CASH, ["A7", "V7", 1, "7", None, None, None]]}))
    out = ingest.parse_workbooks(workbook.read_rows(spark, str(tmp_path)))
    assert sorted((r.sheet, r.problem) for r in out["errors"].collect()) == [("Sheet 7", "UNKNOWN_CHANNEL")]
    assert {r.sheet: r.problem for r in out["sheets"].where("problem IS NOT NULL").collect()} == {"Sheet 7": "UNKNOWN_CHANNEL", "Sheet 8": "ZERO_AMOUNTS"}
    rows = out["rows"].collect()
    assert len(rows) == 6 and {r.sheet for r in rows} == {"Money Transfer to", "Withdrawal through ATM", "Put on hold", "AEPS", "Sheet 9"}
    assert sorted((r.ack_no, r.parent_txn, r.parent_account) for r in out["old_transactions"].collect()) == [("A1", "T1", None), ("A2", None, "P2")]


def test_of_two_cells_in_one_place_the_greater_counts(spark):
    at = lambda r, c, value: ("a.xlsx", 0, "AEPS", r, c, value, None, None, None)
    cells = [at(0, c, h) for c, h in enumerate(CASH)] + [at(1, 0, "A1"), at(1, 1, "V1"), at(1, 3, "5"), at(1, 3, "7"), at(1, 1, "V0")]
    out = ingest.parse_workbooks(spark.createDataFrame(cells, workbook.CELLS), ("rows",))["rows"]
    assert [(r.ack_no, r.victim_account, int(r.transaction_amount)) for r in out.collect()] == [("A1", "V1", 7)]


def test_header_rows_are_found_from_rows_and_from_cells(spark):
    rows = ledger_rows(spark, SF)
    want = rows.where("r = 1").select(*ingest.SHEET, F.lit(1).alias("header_r"))
    assert sorted(want.collect()) == sorted(ingest.header_rows(rows).collect())
    assert sorted(want.collect()) == sorted(ingest.header_rows(ingest.cells_in(rows).withColumns({c: F.lit(None).cast("int") for c in ("merged_to_r", "merged_to_c")}).withColumn("error", F.lit(None).cast("string"))).collect())
