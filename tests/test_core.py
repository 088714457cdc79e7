import datetime
from decimal import Decimal

import pytest

from trailmark.operators import attribution, behaviour, browse, calendar, findings, graph, money, registry, scoring
from trailmark.operators.core import enrich, flag_duplicates, legs, rollup

COLS = "id long, report_id long, ack_no string, victim_account string, beneficiary_account string, beneficiary_bank string, raw_beneficiary_bank string, bank_source string, bank_flag string, ifsc_code string, beneficiary_name string, transaction_date timestamp_ntz, transaction_amount decimal(18,2), disputed_amount decimal(18,2), utr_no string, payment_mode string, layer_no int, atm_id string, atm_location string, city string, state string, remarks string"
NAMES = [c.split()[0] for c in COLS.split(", ")]


def ledger(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        r = {"id": i, "report_id": 1, "ack_no": "C1", "layer_no": 1, "utr_no": f"U{i}"} | r
        if isinstance(r.get("transaction_date"), str):
            r["transaction_date"] = datetime.datetime.fromisoformat(r["transaction_date"])
        for k in ("transaction_amount", "disputed_amount"):
            r[k] = Decimal(r.get(k, r.get("transaction_amount", 0)))
        out.append(tuple(r.get(n) for n in NAMES))
    return spark.createDataFrame(out, COLS)


def hop(a, b, amount=1000, at="2024-01-15T10:00:00", **kw):
    return {"victim_account": a, "beneficiary_account": b, "transaction_amount": amount, "transaction_date": at, "payment_mode": "IMPS"} | kw


def cash(a, amount=1000, at="2024-01-15T12:00:00", mode="ATM", atm_id="ATM1", **kw):
    return hop(a, a, amount, at, payment_mode=mode, atm_id=atm_id, layer_no=2, **kw)


def trail(spark):
    return ledger(
        spark,
        hop("VIC1", "M1", 100000, "2024-03-01T10:00:00", utr_no="U-1", beneficiary_bank="BoB"),
        hop("VIC1", "M1", 100000, "2024-03-01T10:00:00", utr_no="U-1", beneficiary_bank="BoB", payment_mode="ATM"),
        hop("VIC2", "M1", 50000, "2024-03-01T11:00:00", utr_no="U-2", beneficiary_bank="BoB"),
        hop("M1", "M2", 80000, "2024-03-01T14:00:00", utr_no="U-3", disputed_amount=60000, layer_no=2, payment_mode="UPI", beneficiary_bank="Axis"),
        cash("M2", 40000, "2024-03-01T16:00:00", utr_no="U-4", disputed_amount=30000, atm_id="ATMX", beneficiary_bank="Axis"),
        hop("M2", "M2", 20000, "2024-03-02T09:00:00", utr_no="U-5", disputed_amount=0, payment_mode="HOLD", layer_no=2),
    )


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_trail(spark):
    flagged = flag_duplicates(enrich(trail(spark)))
    assert [r.row_kind for r in flagged.orderBy("id").collect()] == ["HOP", "EXIT", "HOP", "HOP", "EXIT", "HOLD"]
    rows = flagged.where("not is_duplicate")
    assert rows.count() == 5
    accounts = rollup(rows)
    m = by(accounts, "account_no")
    assert (m["M1"].total_received, m["M1"].onward_forwarded, m["M1"].lien_eligible_amount, m["M1"].distinct_senders) == (150000, 80000, 70000, 2)
    assert (m["M2"].total_cashed_out, m["M2"].total_on_hold, m["M2"].lien_eligible_amount) == (40000, 20000, 20000)
    s = money.summary(flagged, accounts).first()
    assert (s.duplicate_count, s.unique_transactions, s.victim_loss_amount, s.total_layers) == (1, 3, 150000, 2)
    r = money.recovery(rows, accounts).first()
    assert (r.base_amount, r.cashed_out, r.on_hold, r.recoverable, r.cashed_out_pct) == (150000, 40000, 20000, 90000, 26.7)
    v = by(money.victims(rows), "account_no")
    assert {k: x.amount_sent for k, x in v.items()} == {"VIC1": 100000, "VIC2": 50000}
    layer = by(graph.layers(rows), "layer_no")
    assert (layer[1].txn_count, layer[1].total_amount, layer[1].avg_forward_time_hours) == (2, 150000, 4.0)
    c = money.cashout_view(rows, accounts).first()
    assert (c.same_day_cashouts, c.total_cashout_transactions, c.fastest_cashout_hours) == (1, 1, 6.0)
    assert calendar.timeline_summary(rows).first().first_fraud_date == datetime.date(2024, 3, 1)
    q = money.reconciliation(flagged).first()
    assert q.hop + q.exit + q.hold + q.other == q.total and q.dated + q.undated == q.unique_legs and q.raw_legs == 6


def test_cap_and_attribution(spark):
    bank = dict(beneficiary_bank="HDFC Bank", raw_beneficiary_bank="IndusInd Bank", bank_source="IFSC", bank_flag="IFSC_TEXT_MISMATCH", ifsc_code="HDFC0007077")
    rows = legs(ledger(spark, hop("V1", "M1", 100000, **bank), cash("M1", 120000, **bank), hop("V1", "W1", 30000, beneficiary_bank="Mobikwik", raw_beneficiary_bank="Mobikwik", bank_source="TEXT", bank_flag="NO_IFSC")))
    accounts = rollup(rows)
    c = money.cashout_view(rows, accounts).first()
    assert (c.total_cashout_amount_uncapped, c.total_cashout_amount) == (120000, 100000)
    r = money.recovery(rows, accounts).first()
    assert (r.base_amount, r.recoverable) == (130000, 30000) and r.cashed_out + r.on_hold + r.refunded + r.recoverable == r.base_amount
    flags = attribution.flagged_accounts(rows)
    assert [(f.account_no, f.severity) for f in flags.orderBy("place").collect()] == [("M1", "informational"), ("W1", "informational")]
    assert attribution.quality_summary(rows, flags, money.liens(accounts)).first().status == "green"
    assert money.capped_cashouts(rollup(legs(ledger(spark, cash("Z", 500))))).first().capped == 500  # no inflow, no cap
    one = rollup(legs(ledger(spark, hop("P", "AGG", 1000000, disputed_amount=5000)))).where("account_no = 'AGG'").first()
    assert one.lien_eligible_amount == 5000


def test_dedup_key_and_padded_accounts(spark):
    same = dict(utr_no="U", at="2024-01-01T00:00:00")
    flagged = flag_duplicates(enrich(ledger(spark, hop("A", "0012", 500, **same), hop("A", "12", 500, **same), hop("A", "12", 500, disputed_amount=1, **same), hop("A", "12", 500, utr_no="U", at="2024-01-01T00:01:00"))))
    assert [r.is_duplicate for r in flagged.orderBy("id").collect()] == [False, True, False, False]
    assert attribution.hidden_twins(flagged).first().spellings == 2


def test_layer_fan_out(spark):
    rows = [hop(f"V{i}", f"A{i}", layer_no=1) for i in range(1)] + [hop("A0", f"B{i}", layer_no=2) for i in range(3)] + [hop(f"B{i}", "C", layer_no=3) for i in range(3)]
    layer = by(graph.layers(legs(ledger(spark, *rows))), "layer_no")
    assert [layer[i].fan_out_ratio for i in (1, 2, 3)] == [3.0, 0.3333, None] and [layer[i].fan_out_high for i in (1, 2, 3)] == [True, False, False]


def test_exits_flags(spark):
    rows = legs(ledger(
        spark,
        *[cash("A", 10000, f"2024-01-15T00:{m:02d}:00", atm_id="ATMx") for m in (0, 10, 20)],
        *[cash("B", 5000, f"2024-01-15T{h:02d}:00:00", atm_id="ATMy") for h in (0, 2, 5)],
        *[cash("C", 4000, f"2024-01-15T{h:02d}:00:00", atm_id=f"ATM{h}") for h in (0, 2, 4)],
        *[cash("M", 10000, f"2024-01-15T{t}:00", mode="POS", atm_id="MID9") for t in ("00:00", "00:15", "01:00")],
        *[cash("N", 5000, f"2024-01-15T00:{m:02d}:00", mode="POS", atm_id="MID2") for m in (0, 5)],
    ))
    flags = {(f.flag, f.subject): (f["count"], f.why) for f in behaviour.exit_flags(rows).collect()}
    assert flags == {("rapid", "A"): (3, "3 withdrawals in 20 min"), ("multi_atm", "C"): (3, "3 different ATMs on 2024-01-15"), ("suspicious_merchant", "MID9"): (3, "3 POS txns in 60 min")}
    assert {r.channel: r["count"] for r in behaviour.channels(rows).collect()} == {"ATM": 9, "POS": 5}
    none = legs(ledger(spark, hop("V", "M")))
    assert behaviour.exit_flags(none).count() == 0 and behaviour.channels(none).count() == 0


def test_speed_and_metrics(spark):
    rows = legs(ledger(spark, hop("V", "A", at="2024-01-01T00:00:00"), cash("A", at="2024-01-01T02:00:00"), hop("V", "B", at="2024-01-01T00:00:00"), cash("B", at="2024-01-01T10:00:00"), hop("V", "C", at="2024-01-02T00:00:00"), cash("C", at="2024-01-01T00:00:00")))
    s = behaviour.cashout_speed(rows).first()
    assert (s.account_count, s.median_hours, s.mean_hours) == (2, 6.0, 6.0)
    assert behaviour.cashout_speed(legs(ledger(spark, hop("V", "A")))).first().median_hours is None
    for days, want in ((7, "ok"), (14, "warn"), (15, "danger")):
        held = legs(ledger(spark, hop("V", "A", at="2024-01-01T00:00:00"), hop("A", "A", 100, (datetime.datetime(2024, 1, 1) + datetime.timedelta(days)).isoformat(), payment_mode="HOLD")))
        m = behaviour.investigation_metrics(held, rollup(held)).first()
        assert (m.response_gap_days, m.response_gap_severity, m.recovery_pct, m.recovery_severity) == (days, want, 10.0, "warn")
    m = behaviour.investigation_metrics(rows, rollup(rows)).first()
    assert (m.response_gap_severity, m.recovery_severity) == ("none", "danger")


def test_graph(spark):
    rows = legs(ledger(spark, hop("A", "B", 500, beneficiary_bank="X"), hop("A", "B", 100, beneficiary_bank="Y"), hop("B", "A", 300, beneficiary_bank="X"), hop("B", "C", 50), hop("C", "D", 70), hop("D", "B", 60), *[hop(f"S{i}", "G") for i in range(5)], hop("G", "H")))
    found = {"-".join(c.path): (c.length, c.amount, c.txns, c.banks) for c in graph.cycles(graph.edges(rows)).collect()}
    assert found == {"A-B": (2, 300, 3, ["X", "Y"]), "B-C-D": (3, 50, 3, [])}
    assert graph.cycles(graph.edges(legs(ledger(spark, hop("A", "B"))))).count() == 0
    degrees = graph.connectivity(graph.edges(rows))
    assert by(degrees, "account_no")["G"].in_degree == 5
    agg = graph.aggregators(degrees, rollup(rows))
    assert agg.first().severity == "danger"
    s = graph.aggregator_summary(agg).first()
    assert (s["count"], s.max_fan_in, s.median_fan_in, s.total_held) == (1, 5, 5.0, 4000)


def test_cycles_of_all_lengths(spark):
    rows = [hop(f"n{k}_{i}", f"n{k}_{(i + 1) % k}") for k in range(2, 9) for i in range(k)]
    assert sorted(c.length for c in graph.cycles(graph.edges(legs(ledger(spark, *rows)))).collect()) == [2, 3, 4, 5, 6]


def test_scores(spark):
    high = legs(ledger(
        spark, hop("V1", "M", 100000, "2024-01-15T10:00:00"), hop("V2", "M", 50000, "2024-01-15T10:30:00", ack_no="C2"), hop("V3", "M", 50000, "2024-01-15T10:31:00", ack_no="C3"),
        cash("M", 150000, "2024-01-15T11:00:00"), cash("M", 50000, "2024-01-15T11:05:00", mode="POS"),
    ))
    m = by(scoring.score(high, rollup(high)), "account_no")["M"]
    assert m.mule_score > 70 and m.risk_label == "HIGH" and m.points_in_degree_collector == 6
    assert "High fan-in collector: in-degree 3 (+6)" in m.suspicion_reasons
    low = legs(ledger(spark, hop("V1", "R", 100000)))
    r = by(scoring.score(low, rollup(low)), "account_no")["R"]
    assert r.mule_score < 40 and r.risk_label == "LOW"
    counts = scoring.risk_counts(scoring.score(high, rollup(high)))
    lines = findings.key_findings(money.summary(flag_duplicates(enrich(trail(spark))), rollup(legs(trail(spark)))), counts).collect()
    assert len(lines) == 5 and lines[0].finding == "Victims lost Rs. 1,50,000.00 over 2 layers."


def test_registry_is_idempotent(spark):
    base = registry.contributions(legs(ledger(spark, hop("V", "A", 100), hop("V", "B", 50), hop("V", "A", 70, report_id=2, beneficiary_bank="X"))))
    total = lambda c: {r.account_no: (r.appearance_count, r.total_amount_passed, r.first_seen_report_id, r.bank_name) for r in registry.aggregate(c).collect()}
    assert total(base) == {"A": (2, 170, 1, "X"), "B": (1, 50, 1, None)}
    fresh = spark.createDataFrame([("00A", None, Decimal(5)), ("0012", "Y", Decimal(6)), ("12", None, Decimal(1))], "account_no string, bank_name string, amount_passed decimal(18,2)")
    once = registry.replace_report(base, 1, fresh)
    assert total(once) == total(registry.replace_report(once, 1, fresh)) == {"A": (1, 70, 2, "X"), "00A": (1, 5, 1, None), "12": (1, 7, 1, "Y")}
    assert total(registry.withdraw_report(registry.withdraw_report(once, 1), 1)) == {"A": (1, 70, 2, "X")}
    assert {r.account_no for r in registry.touched(base, once).collect()} == {"A", "B", "00A", "12"}
    stored = spark.createDataFrame([("A", "pending", "old")], "account_no string, status string, remarks string")
    new = spark.createDataFrame([("A", "applied", None), ("B", "pending", "n")], stored.schema)
    assert sorted(tuple(r) for r in registry.upsert(stored, new, ["account_no"]).collect()) == [("A", "applied", "old"), ("B", "pending", "n")]


def test_letters(spark):
    liens = money.liens(rollup(legs(ledger(spark, hop("V", "A", 100, beneficiary_bank="HDFC Bank"), hop("V", "B", 300, beneficiary_bank="hdfc bank"), hop("V", "w@ybl", 5, beneficiary_bank="Y"), hop("V", "XX12", 5, beneficiary_bank="Z")))))
    [letter] = attribution.letters(liens).collect()
    lines = attribution.letter_accounts(liens)
    assert (letter.bank_key, letter.account_count, letter.total_amount) == ("hdfc bank", 2, 400)
    assert {(r.bank_key, r.account_no, r.lien_eligible_amount) for r in lines.collect()} == {("hdfc bank", "A", 100), ("hdfc bank", "B", 300)}

    def diff(*stored):
        rows = [("hdfc bank", a, Decimal(n), "sent") for a, n in stored] + [("gone", "X", Decimal(1), "sent")]
        old = spark.createDataFrame(rows, "bank_key string, account_no string, lien_eligible_amount decimal(18,2), status string")
        return {r.bank_key: (r.status, r.changed_accounts) for r in attribution.letters_to_send(lines, old).collect()}

    assert diff(("A", 100), ("B", 300)) == {"hdfc bank": ("sent", 0), "gone": ("withdrawn", 1)}
    # the same total, but another account, or other amounts
    assert diff(("A", 100), ("C", 300))["hdfc bank"] == ("draft", 2)
    assert diff(("A", 300), ("B", 100))["hdfc bank"] == ("draft", 2)
    assert diff(("A", 100))["hdfc bank"] == ("draft", 1)


def test_browse(spark):
    rows = flag_duplicates(enrich(trail(spark)))
    assert browse.filtered(rows, text="u-3").count() == 1 and browse.filtered(rows, text="%").count() == 0 and browse.filtered(rows, layers=[2], mode="atm").count() == 1
    assert [r.id for r in browse.page(rows, 2, 2, by="transaction_amount").collect()] == [3, 2]
    assert browse.account_legs(rows, "M1").count() == 4 and browse.terminal_legs(rows, "UNKNOWN_ATM").count() == 1
    fields = {r.field: r.value for r in browse.leg_fields(rows, 0).collect()}
    assert fields["victim_account"] == "VIC1" and "city" not in fields
    assert browse.page_counts(rows, 4).first().pages == 2


@pytest.mark.parametrize("empty", [True])
def test_empty_ledger(spark, empty):
    from trailmark.operators.exports import report_tables

    tables = report_tables(trail(spark).limit(0))
    counts = {n: df.count() for n, df in tables.items()}
    # tables of one row, and the bins of hours and weekdays, which are there with zeros
    assert {n for n, c in counts.items() if c} == {"summary", "recovery", "reconciliation", "timeline_summary", "hours", "weekdays"}
    assert counts["hours"] == 24 and tables["hours"].agg({"txns": "sum"}).first()[0] == 0
