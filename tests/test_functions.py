import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trailmark.functions import banks, parse, similar, text


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    values = ["1,23,456.78", "₹ 50,000/-", "(50,000)", "Rs. 12", "INR 7", "-5.5", "", None, "-", "N/A", "12 Cr", "abc", " 50,000.00", "1e3", "(-3)", "₹ -8", "-₹9", "(7", "5 INR", "Rs.1,00,000.50/-", "+4", ".5"]
    want = ["123456.78", "50000", "-50000", "12", "7", "-5.5", "0", "0", "0", "0", "0", "0", "50000", "1000", "3", "-8", "-9", "0", "5", "100000.50", "4", "0.5"]
    assert apply(spark, parse.parse_amount, values) == [Decimal(w).quantize(Decimal("0.01")) for w in want]


def test_dates(spark):
    d = datetime.datetime
    cases = {
        "15/01/2024": d(2024, 1, 15), "01/15/2024": d(2024, 1, 15), "03-04-2024": d(2024, 4, 3), "2024-01-15T05:00:00.000Z": d(2024, 1, 15, 5),
        "15.01.24 05:34:19 PM": d(2024, 1, 15, 17, 34, 19), "15/01/2024 19:09:PM": d(2024, 1, 15, 19, 9), "15/01/2024 12:00:00 AM": d(2024, 1, 15),
        "45306": d(2024, 1, 15), "45306.5": d(2024, 1, 15, 12), "31/02/2024": None, "": None, "n/a": None, "soon": None, "12345": None, "01/02/71": d(1971, 2, 1), "99/99/2024": None,
    }
    assert apply(spark, parse.parse_date, list(cases)) == list(cases.values())


def test_layers_rails_and_terminals(spark):
    assert apply(spark, parse.parse_layer, ["3", "-2", "99", "", None, "x", "2.7", "4 b"]) == [3, 0, 20, 1, 1, 1, 2, 4]
    assert apply(spark, parse.payment_rail, ["NEFT-UPI ref", "DRRTGS-1", "GROUPING", "upi/1", None]) == ["NEFT", "RTGS", None, "UPI", None]
    remark = ["x // Terminal ID : 21258798 // Card acceptor name: SAMPLE  STORE 7", "none"]
    assert apply(spark, parse.terminal_of, remark) == ["21258798", None]
    assert apply(spark, parse.acceptor_of, remark) == ["SAMPLE STORE 7", None]
    names = ["Withdrawal_Through_ATM (1)", "Money Transfer to", "Old Transactions", "Transaction put on hold", "AEPS", "POS", "Others Less Then 500", "Sheet1"]
    assert apply(spark, parse.sheet_category, names) == ["ATM", "TRANSFER", "OLD_TRANSACTION", "HOLD", "AEPS", "POS", "OTHER", None]


def test_text(spark):
    assert apply(spark, text.blank_to_null, [" a ", "-", "—", "N/a", "", None, "﻿x"]) == ["a", None, None, None, None, None, "x"]
    assert apply(spark, text.account_key, ["000", "00440", "A01", " 7 ", None, "", "0"]) == ["0", "440", "A01", "7", "", "", "0"]
    assert apply(spark, text.without_label, [" ATM ID :-123", "Place of ATM :-GOLE   DLIN", "12:30", None]) == ["123", "GOLE DLIN", "12:30", None]
    assert apply(spark, text.masked_account, ["1234567890", "12", "12345678901234567890"]) == ["••••••7890", "12", "••••••••7890"]
    assert apply(spark, text.indian_money, ["123456", "999", "-1234567.5", "12345678.91"], "string")[0] == "Rs. 1,23,456.00"
    assert apply(spark, lambda c: text.indian_money(c.cast("decimal(18,2)")), ["999", "-1234567.5", "12345678.91", "0"]) == ["Rs. 999.00", "-Rs. 12,34,567.50", "Rs. 1,23,45,678.91", "Rs. 0.00"]
    assert apply(spark, text.safe_identifier, ["<a>&\"'`\x01b", None]) == ["ab", ""]


def test_similarity(spark):
    assert apply(spark, lambda c: similar.edit_ratio(c, F.lit("transactiondate")), ["transcationdate"]) == [pytest.approx(1 - 2 / 15)]
    labels = [("transactionamount", "amount"), ("disputedamount", "disputed"), ("beneficiaryname", "name")]

    def best(labels, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        found = {r.i: r.value for r in similar.best_labels(rows, ["i"], "v", labels).collect()}
        return [found.get(i) for i in range(len(values))]

    assert best(labels, "transactionamout", "disputdamount", "beneficiarynam", "zzz", "", "amount") == ["amount", "disputed", "name", None, None, None]
    assert best([("abcdefghij", "x"), ("abcdefghik", "y")], "abcdefghil", "abcdefghij") == [None, None]  # two values too near
    assert best([("abcdefghij", "x"), ("abcdefghik", "x")], "abcdefghil") == ["x"]


def test_banks(spark):
    rows = [
        ("HDFC0007077", "IndusInd Bank", "HDFC Bank", "IFSC", "IFSC_TEXT_MISMATCH"), ("hdfc0007077", "HDFC", "HDFC Bank", "IFSC", None), ("PPIW0123456", "Mobikwik", "Mobikwik", "TEXT", "NO_IFSC"),
        ("ZZZZ0000001", "", "Unknown (IFSC ZZZZ)", "TEXT", "UNKNOWN_IFSC_PREFIX"), ("bad", None, "Unknown", "TEXT", "INVALID_IFSC"), (None, "X", "X", "TEXT", "NO_IFSC"),
        ("BKID0000001", "Union Bank of India", "Bank of India", "IFSC", "IFSC_TEXT_MISMATCH"), ("BARB0000001", "Others", "Bank of Baroda (including Vijaya Bank and Dena Bank)", "IFSC", None),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, ifsc_code string, raw_beneficiary_bank string")
    got = [(r.beneficiary_bank, r.bank_source, r.bank_flag) for r in banks.with_bank(df).orderBy("i").collect()]
    # without the words that all banks share 'union' is left of one; nothing is left of the other, so that all its words count
    assert got == [r[2:] for r in rows]
    kinds = spark.createDataFrame([("9@ybl", None, None), ("1", "PPIW0123456", "X"), ("1", None, "Paytm"), ("1", None, "Paytm Payments Bank"), ("XXXX12", "HDFC0000001", "HDFC"), ("NA", "PHONEPE", ""), ("na", None, "HDFC")], "a string, i string, b string")
    assert [r.k for r in kinds.select(banks.instrument_kind(F.col("a"), F.col("i"), F.col("b")).alias("k")).collect()] == ["wallet", "wallet", "wallet", "bank", "masked", "wallet", "masked"]
