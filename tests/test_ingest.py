import datetime
import io
import zipfile
from decimal import Decimal
from xml.sax.saxutils import escape

from trailmark.operators import ingest
from trailmark.operators.core import legs, rollup
from trailmark.sources import workbook

TRANSFER = ["Acknowledgement No", "Account No./ (Wallet /PG/PA) Id", "Bank/FIs", "Layer", "Account No", "Action Taken By bank", "IFSC Code", "Transaction Date", "Transaction Amount", "Disputed Amount", "UTR/Reference No", "Remarks"]
CASH = ["Acknowledgement No", "Account No./ (Wallet /PG/PA) Id", "Layer", "Transaction Amount", "Transaction Date", "Action Taken By bank", "Remarks"]


def column(c):
    return (chr(64 + c // 26) if c >= 26 else "") + chr(65 + c % 26)


def xlsx(sheets, merges=()):
    """A small workbook: numbers as numbers, texts as shared or inline ones by turns."""
    shared, parts = [], []
    for rows in sheets.values():
        xml = []
        for r, row in enumerate(rows):
            cells = []
            for c, v in enumerate(row):
                ref = f"{column(c)}{r + 1}"
                if v is None:
                    continue
                if isinstance(v, (int, float)):
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif (r + c) % 2:
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                else:
                    shared.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            xml.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
        merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
        parts.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(xml)}</sheetData><mergeCells>{merged}</mergeCells></worksheet>')
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        for i, p in enumerate(parts):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", p)
    return out.getvalue()


def parse(spark, tmp_path, sheets, name="a.xlsx", **kw):
    (tmp_path / name).write_bytes(xlsx(sheets, **kw))
    return ingest.parse_workbooks(workbook.read_workbooks(spark, str(tmp_path / name)))


def sheets():
    return {
        "Money Transfer to": [
            ["Complete trail"],
            TRANSFER,
            ["A1", "V1", "SBI", 1, "0012", "IndusInd Bank", "HDFC0007077", "15/01/2024 10:00:00 AM", "1,00,000.00", "₹ 90,000", "U1", "NEFT-UPI ref"],
            TRANSFER,
            ["A1", "12", "SBI", 2, "M2", "Mobikwik", "PPIW0123456", 45306.5, 5000, 5000, "U2", None],
            [None, None, None, None, None, None, None, None, None, None, None, "no account: dropped"],
        ],
        "Withdrawal through ATM": [CASH, ["A1", "12", 2, "40000", "16/01/2024", None, "x // Terminal ID : 21258798 // Card acceptor name: SHOP ONE"]],
        "Put on hold": [CASH, ["A1", "M2", 2, "500", "17-01-2024", None, None]],
        "Old Transaction": [["Acknowledgement No", "Account No.", "Transaction Amount", "Transaction Date"], ["A1", "OLD1", "0", "01/01/2023"]],
    }


def test_multi_sheet_workbook(spark, tmp_path):
    out = parse(spark, tmp_path, sheets())
    assert out["errors"].count() == 0
    rows = {(r.sheet, r.r): r for r in out["rows"].collect()}
    assert len(rows) == 4
    a = rows[("Money Transfer to", 2)]
    assert (a.beneficiary_account, a.beneficiary_bank, a.bank_flag, a.payment_mode) == ("0012", "HDFC Bank", "IFSC_TEXT_MISMATCH", "NEFT")
    assert (a.transaction_amount, a.disputed_amount, a.transaction_date) == (Decimal(100000), Decimal(90000), datetime.datetime(2024, 1, 15, 10))
    assert rows[("Money Transfer to", 4)].transaction_date == datetime.datetime(2024, 1, 15, 12)
    c = rows[("Withdrawal through ATM", 1)]
    assert (c.beneficiary_account, c.payment_mode, c.atm_id, c.atm_location, c.beneficiary_bank) == ("12", "ATM", "21258798", "SHOP ONE", None)
    assert [r.victim_account or r.beneficiary_account for r in out["old_transactions"].collect()] == ["OLD1"]
    ledger = ingest.with_ids(out["rows"], 7)
    assert ledger.select("id").distinct().count() == 4 and ingest.row_problems(ledger).count() == 0
    accounts = {x.account_no: x for x in rollup(legs(ledger)).collect()}
    assert (accounts["12"].total_received, accounts["12"].total_cashed_out, accounts["M2"].total_on_hold) == (100000, 40000, 500)


def test_refused_sheets(spark, tmp_path):
    out = parse(
        spark,
        tmp_path,
        {
            "Money Transfer to": [[h for h in TRANSFER if h != "Disputed Amount"], ["A1", "V1", "SBI", 1, "M1", "X", None, "15/01/2024", "10", "U1", None]],
            "Sheet 7": [[h for h in CASH if "bank" not in h], ["A1", "V1", 1, "10", "15/01/2024", None]],
            "Sheet 8": [[h for h in CASH if "bank" not in h], ["A1", "V1", 1, "0.00", "15/01/2024", None]],
            "Withdrawl through ATM s": [CASH, ["A1", "V2", 1, "10", "15/01/2024", None, None]],
            "notes": [["a", "b"], ["c", "d"]],
        },
    )
    assert {(r.sheet, r.problem) for r in out["errors"].collect()} == {("Money Transfer to", "REQUIRED_COLUMN_MISSING"), ("Sheet 7", "UNKNOWN_CHANNEL")}
    assert {(r.sheet, r.payment_mode) for r in out["rows"].collect()} == {("Withdrawl through ATM s", "ATM")}
    assert {r.sheet: r.problem for r in out["sheets"].collect()}["Sheet 8"] == "ZERO_AMOUNTS"


def test_headers_similar_and_merged(spark, tmp_path):
    rows = [["Acknowledgement No", "Account No./ (Wallet /PG/PA) Id", "Layer-No.", "Transacton Amount", "Date", "Remarks"], ["A1", "V1", 1, "10", "15/01/2024", None], [None, "V2", 2, "20", "15/01/2024", None]]
    out = parse(spark, tmp_path, {"AEPS": rows}, merges=["A2:A3"])
    mapping = {r.field: (r.c, r.how) for r in out["mapping"].collect()}
    assert mapping["layer_no"] == (2, "exact") and mapping["transaction_amount"] == (3, "similar")
    got = sorted((r.ack_no, r.victim_account, r.transaction_amount, r.layer_no) for r in out["rows"].collect())
    assert got == [("A1", "V1", Decimal(10), 1), ("A1", "V2", Decimal(20), 2)]


def test_broken_files_and_hashes(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "y.xls").write_bytes(b"\xd0\xcf\x11\xe0 old")
    out = ingest.parse_workbooks(workbook.read_workbooks(spark, str(tmp_path)))
    assert sorted(r.problem for r in out["errors"].collect()) == ["not an .xlsx workbook", "the workbook can't be read: BadZipFile"]
    assert out["rows"].count() == 0
    assert all(len(r.source_sha256) == 64 for r in workbook.file_hashes(spark, str(tmp_path)).collect())
    assert len(workbook.workbook_cells("p", b"0" * (workbook.MAX_BYTES + 1))) == 1
