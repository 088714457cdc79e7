"""The streaming reader of workbooks, and workbooks as a stream."""

import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from test_ingest import CASH, TRANSFER, column, sheets, xlsx
from trailmark.operators import ingest as steps
from trailmark.sources import workbook
from trailmark.sources.store import VersionedStore
from trailmark.streaming import ingest

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def with_sheet(write, compression=zipfile.ZIP_DEFLATED):
    """A workbook of one sheet, whose XML ``write`` streams."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx({"AEPS": []}))) as old, zipfile.ZipFile(out, "w", compression) as new:
        for name in old.namelist():
            if "sheet1" not in name:
                new.writestr(name, old.read(name))
        with new.open("xl/worksheets/sheet1.xml", "w") as f:
            write(f)
    return out.getvalue()


def large(n):
    def write(f):
        f.write(f'<?xml version="1.0"?><worksheet {NS}><cols/><sheetData>'.encode())
        for r in range(1, n + 1):
            f.write(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="B{r}" t="inlineStr"><is><t>n{r % 7}</t></is></c></row>'.encode())
        f.write(b'</sheetData><mergeCells><mergeCell ref="B2:C5"/></mergeCells></worksheet>')

    return with_sheet(write)


@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_cells(compression, monkeypatch):
    monkeypatch.setattr(workbook, "PIECE", 7)  # elements and characters are cut anywhere
    rows = [["Ärger & <b>", None, 3], [None, "x", 2.5]]
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx({"Ä": rows, "none": [], "b": [[1]]}, merges=["A1:B1"]))) as old, zipfile.ZipFile(out, "w", compression) as new:
        for name in old.namelist():
            new.writestr(name, old.read(name))
    got = workbook.workbook_cells("p", out.getvalue())
    assert got == [
        ("p", 0, "Ä", 0, 0, "Ärger & <b>", 0, 1, None), ("p", 0, "Ä", 0, 2, "3", None, None, None), ("p", 0, "Ä", 1, 1, "x", None, None, None),
        ("p", 0, "Ä", 1, 2, "2.5", None, None, None), ("p", 2, "b", 0, 0, "1", 0, 1, None),
    ]


def test_memory_does_not_grow_with_rows():
    peaks = []
    for n in (5_000, 100_000):
        [part] = workbook.workbook_parts("p", large(n))
        tracemalloc.start()
        count = sum(1 for _ in workbook.sheet_cells(part))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count == 2 * n
    assert peaks[1] < 1.5 * peaks[0] + (1 << 20)


def test_a_million_rows(spark, tmp_path):
    n = 1_000_000
    (tmp_path / "a.xlsx").write_bytes(large(n))
    (tmp_path / "b.xlsx").write_bytes(xlsx(sheets()))
    cells = workbook.read_workbooks(spark, str(tmp_path))
    a = cells.where(F.col("path").endswith("a.xlsx"))
    got = a.agg(F.count("*"), F.sum(F.when(F.col("c") == 0, F.col("value").cast("long"))), F.max("r"), F.count("error"), F.countDistinct(F.when(F.col("c") == 1, F.col("value"))), F.count("merged_to_r")).first()
    assert tuple(got) == (2 * n, n * (n + 1) // 2, n - 1, 0, 7, 1)


def test_sheets_are_dealt(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.xlsx").write_bytes(xlsx(sheets()))
    parts = workbook.read_workbooks(spark, str(tmp_path)).select("path", "sheet_no").distinct()
    assert parts.count() == 12


def test_what_is_refused(monkeypatch):
    broken = with_sheet(lambda f: f.write(f'<worksheet {NS}><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetDat'.encode()))
    assert [c[8] for c in workbook.workbook_cells("p", broken)] == ["the workbook can't be read: ParseError"]
    assert [c[8] for c in workbook.workbook_cells("p", xlsx({"a": []}))] == ["the workbook is empty"]
    assert [c[8] for c in workbook.workbook_cells("p", xlsx({"a": [["x"]]})[:-30])] == ["the workbook can't be read: BadZipFile"]
    monkeypatch.setattr(workbook, "MAX_SHEET_BYTES", 10_000)
    assert [c[8] for c in workbook.workbook_cells("p", large(1000))] == ["the workbook unpacks to too much"]


def test_workbooks_as_a_stream(spark, tmp_path):
    folder, store = tmp_path / "in", VersionedStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    cash = lambda n: xlsx({"Withdrawal through ATM": [CASH, *(["A1", f"V{i}", 1, "10", "15/01/2024", None, None] for i in range(n))]})
    taken = []

    def handle(tables, files, number):
        if store.done("stream", str(number)):
            return
        base, rows = store.current(), steps.with_ids(tables["rows"], 1)
        store.commit({"rows": {str(number): store.write(rows)}}, base, "stream", str(number))
        taken.extend(r.path.rsplit("/", 1)[1] for r in files.collect())

    def run():
        ingest.ingest_workbooks(ingest.workbook_files(spark, str(folder)), str(tmp_path / "c"), handle).awaitTermination()
        return store.read("rows").count(), sorted(taken)

    first = cash(3)
    (folder / "a.xlsx").write_bytes(first)
    assert run() == (3, ["a.xlsx"])
    (folder / "b.xlsx").write_bytes(first)  # the same under another name
    (folder / "c.xlsx").write_bytes(cash(4))  # changed
    assert run() == (7, ["a.xlsx", "c.xlsx"])
    assert run() == (7, ["a.xlsx", "c.xlsx"])
    assert len(TRANSFER) and column(27) == "AB"
