"""Every query by name: a callable over (spark, data folder), and its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import banks, parse, text
from trailmark.operators import attribution, behaviour, browse, calendar, exports, findings, graph, ingest, money, pages, registry, scoring, textindex
from trailmark.operators.core import enrich, flag_duplicates, legs, one_row, rollup, stored_legs
from trailmark.operators.registry_view import RegistryView, store_upsert
from trailmark.plans.sql import EDGES, ROLLUP, on_events, on_ledger
from trailmark.session import cut, kept_dir, stored
from trailmark.sources.adapter import events_ledger, ledger
from trailmark.sources.demo import demo_trail
from trailmark.sources.sheets import ledger_rows
from trailmark.sources.store import VersionedStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def edge(df: DataFrame) -> DataFrame:
    """Columns as a reader outside gets them: decimals as doubles, dates and times as text, lists joined by '; '."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "; ")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(out)


def query(name: str, sql: str | None = None, source: Callable = ledger):
    """Registers a function of a ledger (and its legs) as a query over the driver's tables."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: edge(f(source(spark, sf_dir)))
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _flagged(l: DataFrame) -> DataFrame:
    return flag_duplicates(enrich(l))


def _legs(l: DataFrame, *more: str) -> DataFrame:
    """Legs that are kept, for queries that need them more than once; ``more`` columns than sums need."""
    return stored_legs(l, *more).where("NOT is_duplicate")


#: Columns that scores, and that flags of banks read besides.
_SCORED = ("day", "ack_no", "city", "beneficiary_name", "payment_mode")
_BANKED = ("bank_source", "bank_flag", "raw_beneficiary_bank")


D = lambda c, name=None: f"CAST({c} AS DOUBLE) AS {name or c}"
S = lambda c, name=None: f"CAST({c} AS VARCHAR) AS {name or c}"
PCT = lambda a, b: f"CAST(CASE WHEN {b} > 0 THEN round(CAST({a} AS DECIMAL(20,4)) * 100 / {b}, 1) ELSE 0 END AS DOUBLE)"


# -- core --------------------------------------------------------------------
@query("enriched_legs", on_ledger(select=f"SELECT id, row_kind, cashout_mode, cash_account, victim_key, benef_key, is_duplicate, {S('day')}, beneficiary_bank, bank_source, bank_flag, {D('disputed_amount')} FROM flagged"))
def _(l):
    return _flagged(l).select("id", "row_kind", "cashout_mode", "cash_account", "victim_key", "benef_key", "is_duplicate", "day", "beneficiary_bank", "bank_source", "bank_flag", "disputed_amount")


@query("duplicate_legs", on_ledger(select=f"SELECT id, victim_key, benef_key, utr_no, {D('transaction_amount')} FROM flagged WHERE is_duplicate"))
def _(l):
    return _flagged(l).where("is_duplicate").select("id", "victim_key", "benef_key", "utr_no", "transaction_amount")


_ACCOUNT = ["account_no", "bank_name", "ifsc_code", "layer_no", "total_received", "disputed_received", "onward_forwarded", "disputed_forwarded", "total_cashed_out", "total_on_hold", "distinct_senders", "hops_in", "txn_count", "first_received", "total_forwarded", "gross_balance", "lien_eligible_amount"]
_MONEY = {"total_received", "disputed_received", "onward_forwarded", "disputed_forwarded", "total_cashed_out", "total_on_hold", "total_forwarded", "gross_balance", "lien_eligible_amount", "cap_excess"}
_cols = lambda names: ", ".join(D(c) if c in _MONEY else S(c) if c == "first_received" else c for c in names)


@query("account_rollup", on_ledger(ROLLUP, select=f"SELECT {_cols(_ACCOUNT)} FROM accounts"))
def _(l):
    return rollup(legs(l)).select(_ACCOUNT)


# -- money -------------------------------------------------------------------
@query("cashout_cap", on_ledger(ROLLUP, select=f"SELECT account_no, {D('cashed')}, {D('capped')}, cashed - capped > 0.005 AS exceeded FROM capped"))
def _(l):
    return money.capped_cashouts(rollup(legs(l)))


@query("lien_calculation", on_ledger(ROLLUP, select=f"SELECT account_no, bank_name, ifsc_code, layer_no, {_cols([c for c in _ACCOUNT if c in ('total_received', 'disputed_received', 'onward_forwarded', 'total_cashed_out', 'total_on_hold', 'gross_balance', 'lien_eligible_amount')])}, {D('gross_balance - lien_eligible_amount', 'cap_excess')} FROM liens"))
def _(l):
    return money.liens(rollup(legs(l)))


@query("lien_excluded", on_ledger(ROLLUP, select=f"SELECT account_no, bank_name, {D('gross_balance')}, 'no disputed inflow' AS excluded_reason FROM accounts WHERE gross_balance > 0 AND lien_eligible_amount = 0"))
def _(l):
    return money.excluded_liens(rollup(legs(l)))


@query("victim_accounts", on_ledger(ROLLUP, select=f"SELECT victim_key AS account_no, count(*) AS txn_count, {D('sum(transaction_amount)', 'amount_sent')} FROM first_layer GROUP BY 1"))
def _(l):
    return money.victims(_legs(l))


_RECOVERABLE = "greatest(base_amount - cashed_out - on_hold, 0)"


@query("recovery_status", on_ledger(ROLLUP, select=f"SELECT {D('base_amount')}, {D('cashed_out')}, {D('on_hold')}, 0.0::DOUBLE AS refunded, {D(_RECOVERABLE, 'recoverable')}, {PCT('cashed_out', 'base_amount')} AS cashed_out_pct, {PCT('on_hold', 'base_amount')} AS on_hold_pct, 0.0::DOUBLE AS refunded_pct, {PCT(_RECOVERABLE, 'base_amount')} AS recoverable_pct FROM money"))
def _(l):
    rows = _legs(l)
    return money.recovery(rows, rollup(rows))


_K = lambda k, extra="": f"CAST(coalesce(sum(disputed_amount) FILTER (WHERE row_kind = '{k}' {extra}), 0) AS DOUBLE)"


@query("reconciliation", on_ledger(select=f"""SELECT {_K('HOP')} AS raw_hop, {_K('HOP', 'AND is_duplicate')} AS dedup_hop_adjustment, {_K('HOP', 'AND NOT is_duplicate')} AS hop, {_K('EXIT', 'AND NOT is_duplicate')} AS exit,
 {_K('HOLD', 'AND NOT is_duplicate')} AS hold, {_K('OTHER', 'AND NOT is_duplicate')} AS other, {D("sum(disputed_amount) FILTER (WHERE NOT is_duplicate)", "total")}, count(*) FILTER (WHERE NOT is_duplicate AND transaction_date IS NOT NULL) AS dated,
 count(*) FILTER (WHERE NOT is_duplicate AND transaction_date IS NULL) AS undated, {D("coalesce(sum(transaction_amount) FILTER (WHERE NOT is_duplicate AND transaction_date IS NULL), 0)", "undated_amount")},
 count(*) FILTER (WHERE NOT is_duplicate) AS unique_legs, count(*) FILTER (WHERE is_duplicate) AS duplicates, count(*) AS raw_legs FROM flagged"""))
def _(l):
    return money.reconciliation(_flagged(l))


@query("report_summary", on_ledger(ROLLUP, select=f"""SELECT count(*) AS total_transactions, count(*) FILTER (WHERE NOT is_duplicate AND row_kind = 'HOP') AS unique_transactions, count(*) FILTER (WHERE is_duplicate) AS duplicate_count,
 count(DISTINCT layer_no) FILTER (WHERE NOT is_duplicate AND row_kind = 'HOP') AS total_layers, {D("sum(disputed_amount) FILTER (WHERE NOT is_duplicate)", "total_disputed_amount")}, {S("min(day) FILTER (WHERE NOT is_duplicate)", "fraud_start_date")},
 (SELECT count(*) FROM accounts WHERE hops_in > 0) AS total_accounts, {D("(SELECT sum(lien_eligible_amount) FROM accounts)", "lien_table_total")}, {D("(SELECT base_amount FROM money)", "victim_loss_amount")}, {D("(SELECT cashed_out FROM money)", "cashed_out")},
 {D("(SELECT on_hold FROM money)", "on_hold")}, 0.0::DOUBLE AS refunded, {D(f"(SELECT {_RECOVERABLE} FROM money)", "recoverable_residual")} FROM flagged"""))
def _(l):
    flagged = stored_legs(l, "day")
    # what a summary doesn't read of the accounts is not made
    return money.summary(flagged, cut(rollup(flagged.where("NOT is_duplicate")).select(*money.SUMMARIZED)))


_RECEIPTS = "receipts AS (SELECT benef_key AS account, min(day) AS first_day FROM legs WHERE row_kind = 'HOP' AND day IS NOT NULL GROUP BY 1)"
_SAME_DAY = "same_day AS (SELECT legs.* FROM legs JOIN receipts ON cash_account = account AND day = first_day WHERE row_kind = 'EXIT' AND cashout_mode = 'ATM')"


@query("same_day_cashouts", on_events(_RECEIPTS, _SAME_DAY, select=f"SELECT id, cash_account, {S('day')}, atm_id, {D('transaction_amount')} FROM same_day"), events_ledger)
def _(l):
    return money.same_day_exits(_legs(l, "day", "cashout_mode", "atm_id")).select("id", "cash_account", "day", "atm_id", "transaction_amount")


@query("cashout_analysis", on_ledger(ROLLUP, _RECEIPTS, _SAME_DAY, select=f"""SELECT {D("(SELECT coalesce(sum(capped), 0) FROM capped)", "total_cashout_amount")}, {D("(SELECT sum(transaction_amount) FROM legs WHERE row_kind = 'EXIT')", "total_cashout_amount_uncapped")}, 'CAP_AT_RECEIVED' AS cashout_policy,
 (SELECT count(*) FROM legs WHERE row_kind = 'EXIT') AS total_cashout_transactions, (SELECT count(*) FROM same_day) AS same_day_cashouts,
 (SELECT round(date_diff('second', d, (SELECT min(transaction_date) FROM legs WHERE row_kind = 'EXIT' AND transaction_date >= d)) / 3600, 2) FROM (SELECT min(transaction_date) AS d FROM first_layer)) AS fastest_cashout_hours"""))
def _(l):
    rows = _legs(l, "day", "cashout_mode")
    return money.cashout_view(rows, rollup(rows))


@query("cashout_by_state", on_ledger(select=f"SELECT state, {D('sum(transaction_amount)', 'amount')}, count(*) AS \"count\" FROM legs WHERE row_kind = 'EXIT' GROUP BY state"))
def _(l):
    return money.cashouts_by(legs(l), "state")


@query("cashout_by_terminal", on_ledger(select=f"SELECT atm_id, atm_location, city, state, {D('sum(transaction_amount)', 'amount')}, count(*) AS \"count\" FROM legs WHERE row_kind = 'EXIT' GROUP BY ALL"))
def _(l):
    return money.cashouts_by(legs(l), "atm_id", "atm_location", "city", "state")


# -- graph -------------------------------------------------------------------
_LISTS = "array_to_string(layers, '; ') AS layers, array_to_string(banks, '; ') AS banks"


@query("hop_edges", on_ledger(EDGES, select=f"SELECT source, destination, {D('amount')}, {D('disputed')}, txns, {_LISTS} FROM edges"))
def _(l):
    return graph.edges(legs(l))


@query("top_edges", on_ledger(EDGES, select=f"SELECT source, destination, {D('amount')}, {D('disputed')}, txns, {_LISTS} FROM edges ORDER BY edges.amount DESC, source, destination LIMIT 10"))
def _(l):
    return graph.edges(legs(l)).orderBy(F.desc("amount"), "source", "destination").limit(10)


@query("connectivity", on_ledger(EDGES, select=f"SELECT account_no, in_degree, out_degree, {D('total_in')}, {D('total_out')}, coalesce(bank, '') AS bank, in_degree >= 2 AS is_collector FROM degrees"))
def _(l):
    return graph.connectivity(graph.edges(legs(l)))


@query("top_collectors", on_ledger(EDGES, select=f"SELECT account_no, in_degree, out_degree, {D('total_in')}, {D('total_out')}, coalesce(bank, '') AS bank, true AS is_collector FROM degrees WHERE in_degree >= 2 ORDER BY degrees.in_degree DESC, degrees.total_in DESC, account_no LIMIT 25"))
def _(l):
    return graph.collectors(graph.connectivity(graph.edges(legs(l))))


_AGG = "aggregators AS (SELECT account_no, in_degree AS distinct_senders, CASE WHEN in_degree >= 5 THEN 'danger' ELSE 'warn' END AS severity, total_received, gross_balance AS held, layer_no FROM degrees JOIN accounts USING (account_no) WHERE in_degree >= 3)"


@query("aggregator_accounts", on_ledger(EDGES, ROLLUP, _AGG, select=f"SELECT account_no, distinct_senders, severity, {D('total_received')}, {D('held')}, layer_no FROM aggregators"))
def _(l):
    rows = _legs(l)
    return graph.aggregators(graph.connectivity(graph.edges(rows)), rollup(rows))


@query("aggregator_summary", on_ledger(EDGES, ROLLUP, _AGG, select=f"SELECT count(*) AS \"count\", max(distinct_senders) AS max_fan_in, median(distinct_senders) AS median_fan_in, {D('sum(held)', 'total_held')}, {D('sum(total_received)', 'total_received')} FROM aggregators"))
def _(l):
    rows = _legs(l)
    return graph.aggregator_summary(graph.aggregators(graph.connectivity(graph.edges(rows)), rollup(rows)))


_LAYERS = """
base AS (SELECT layer_no, count(*) FILTER (WHERE row_kind = 'HOP') AS txn_count, count(DISTINCT benef_key) FILTER (WHERE row_kind = 'HOP') AS account_count, sum(transaction_amount) FILTER (WHERE row_kind = 'HOP') AS total_amount,
  sum(disputed_amount) FILTER (WHERE row_kind = 'HOP') AS disputed_amount, count(*) FILTER (WHERE row_kind = 'EXIT') AS cashout_count FROM legs WHERE row_kind IN ('HOP', 'EXIT') GROUP BY layer_no),
ranked AS (SELECT layer_no, beneficiary_bank, count(*) AS n, row_number() OVER (PARTITION BY layer_no ORDER BY count(*) DESC, beneficiary_bank) AS r FROM legs WHERE row_kind = 'HOP' AND trim(beneficiary_bank) <> '' GROUP BY layer_no, beneficiary_bank),
banks AS (SELECT layer_no, count(*) AS bank_count, string_agg(beneficiary_bank || ' (' || n || ')', '; ' ORDER BY r) FILTER (WHERE r <= 3) AS top_banks FROM ranked GROUP BY layer_no),
got AS (SELECT layer_no, benef_key, min(transaction_date) AS t, arg_min(ack_no, {'d': transaction_date, 'a': ack_no}) AS ack_no FROM legs WHERE row_kind = 'HOP' AND transaction_date IS NOT NULL GROUP BY ALL),
moves AS (SELECT DISTINCT ack_no, layer_no, transaction_date AS n FROM legs WHERE row_kind = 'HOP' AND transaction_date IS NOT NULL),
hours AS (SELECT layer_no, round(sum(date_diff('second', t, n)) / count(*) / 3600, 2) AS avg_forward_time_hours
  FROM (SELECT got.layer_no, got.t, moves.n FROM got ASOF JOIN moves ON got.ack_no = moves.ack_no AND got.layer_no + 1 = moves.layer_no AND got.t <= moves.n) GROUP BY layer_no)"""


@query("layer_analysis", on_ledger(_LAYERS, select=f"""SELECT b.layer_no, b.txn_count, b.account_count, coalesce(bank_count, 0) AS bank_count, {D("b.total_amount", "total_amount")}, {D("b.disputed_amount", "disputed_amount")}, b.cashout_count,
 round(nxt.account_count / b.account_count, 4) AS fan_out_ratio, coalesce(round(nxt.account_count / b.account_count, 4) >= 2.0, false) AS fan_out_high, top_banks, avg_forward_time_hours
 FROM base b LEFT JOIN base nxt ON nxt.layer_no = b.layer_no + 1 LEFT JOIN banks ON banks.layer_no = b.layer_no LEFT JOIN hours ON hours.layer_no = b.layer_no"""))
def _(l):
    return graph.layers(_legs(l, "ack_no"))


@query("layer_flows", on_ledger(select=f"""SELECT CASE WHEN row_kind = 'HOP' AND layer_no = (SELECT min(layer_no) FROM legs WHERE row_kind = 'HOP') THEN 'origin' WHEN row_kind = 'HOP' THEN 'layer:' || (layer_no - 1) ELSE 'layer:' || layer_no END AS source,
 CASE row_kind WHEN 'HOP' THEN 'layer:' || layer_no WHEN 'EXIT' THEN 'sink:cashout' ELSE 'sink:hold' END AS target, {D("sum(transaction_amount)", "gross")}, {D("sum(disputed_amount)", "disputed")}, count(*) AS txns FROM legs WHERE row_kind IN ('HOP', 'EXIT', 'HOLD') GROUP BY 1, 2"""))
def _(l):
    return graph.layer_flows(_legs(l))


_CYCLES = """
walks AS (
  SELECT source AS start, destination AS last, [source, destination] AS path, 1 AS length, amount, txns, banks FROM edges WHERE source < destination
  UNION ALL
  SELECT start, e.destination, list_append(path, e.destination), length + 1, least(w.amount, e.amount), w.txns + e.txns, list_distinct(list_concat(w.banks, e.banks))
  FROM walks w JOIN edges e ON e.source = w.last WHERE length < 6 AND w.last <> w.start AND (e.destination = start OR (e.destination > start AND NOT list_contains(path, e.destination)))),
cycles AS (SELECT path[1:length] AS path, length, amount, txns, banks FROM walks WHERE last = start AND length >= 2)"""
_CYCLE_COLS = f"array_to_string(path, '; ') AS path, length, {D('amount')}, txns, array_to_string(list_sort(banks), '; ') AS banks"


@query("cycles", on_ledger(EDGES, _CYCLES, select=f"SELECT {_CYCLE_COLS} FROM cycles"))
def _(l):
    return graph.cycles(graph.edges(legs(l)))


@query("top_cycles", on_ledger(EDGES, _CYCLES, select=f"SELECT {_CYCLE_COLS} FROM cycles ORDER BY cycles.amount DESC, cycles.length, array_to_string(cycles.path, '; ') LIMIT 10"))
def _(l):
    return graph.top_cycles(graph.edges(legs(l)))


@query("cycle_totals", on_ledger(EDGES, _CYCLES, select="SELECT count(*) AS cycles, count(*) FILTER (WHERE length = 2) AS two_way, (SELECT count(*) FROM legs WHERE row_kind = 'OTHER' AND victim_key <> '' AND victim_key = benef_key) AS self_loops FROM cycles"))
def _(l):
    rows = _legs(l)
    return graph.cycle_totals(rows, graph.edges(rows))


# -- behaviour ---------------------------------------------------------------
@query("exit_channels", on_events(select=f"SELECT channel, count(*) AS \"count\", {D('sum(transaction_amount)', 'amount')}, {D('sum(disputed_amount)', 'disputed')}, count(DISTINCT atm_id) AS unique_points FROM exits GROUP BY channel"), events_ledger)
def _(l):
    return behaviour.channels(legs(l))


@query("top_exit_points", on_events(select=f"SELECT * EXCLUDE (a), CAST(a AS DOUBLE) AS amount FROM (SELECT channel, atm_id, sum(transaction_amount) AS a, count(*) AS \"count\", row_number() OVER (PARTITION BY channel ORDER BY sum(transaction_amount) DESC, atm_id) AS rank FROM exits GROUP BY channel, atm_id) WHERE rank <= 10"), events_ledger)
def _(l):
    return behaviour.top_exit_points(legs(l), "atm_id")


def _burst(key: str, channel: str) -> str:
    return on_events(
        f"""seen AS (SELECT {key}, transaction_date AS first, count(*) OVER w AS n, sum(transaction_amount) OVER w AS s, max(transaction_date) OVER w AS last FROM exits WHERE channel = '{channel}' AND transaction_date IS NOT NULL AND {key} IS NOT NULL
             WINDOW w AS (PARTITION BY {key} ORDER BY epoch(date_trunc('second', transaction_date)) RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING))""",
        "best AS (SELECT *, row_number() OVER (PARTITION BY KEY ORDER BY n DESC, date_trunc('second', first), first, s DESC) AS r FROM seen WHERE n >= 3)".replace("KEY", key),
        select=f"SELECT {key}, n AS \"count\", {D('s', 'total_amount')} FROM best WHERE r = 1",
    )


@query("rapid_withdrawals", _burst("cash_account", "ATM"), events_ledger)
def _(l):
    return behaviour.rapid_withdrawals(legs(l)).select("cash_account", "count", "total_amount")


@query("suspicious_merchants", _burst("atm_id", "POS"), events_ledger)
def _(l):
    return behaviour.suspicious_merchants(legs(l)).select("atm_id", "count", "total_amount")


@query("multi_atm_accounts", on_events("days AS (SELECT cash_account, day, count(DISTINCT atm_id) AS distinct_atms, count(*) AS n, sum(transaction_amount) AS s FROM exits WHERE channel = 'ATM' AND day IS NOT NULL AND has_terminal GROUP BY ALL)", "best AS (SELECT *, row_number() OVER (PARTITION BY cash_account ORDER BY distinct_atms DESC, day) AS r FROM days WHERE distinct_atms >= 3)", select=f"SELECT cash_account, {S('day')}, distinct_atms, n AS \"count\", {D('s', 'total_amount')} FROM best WHERE r = 1"), events_ledger)
def _(l):
    return behaviour.multi_atm(legs(l))


def _seen(key: str, channel: str, name: str) -> tuple[str, str]:
    return (
        f"""seen_{name} AS (SELECT {key} AS subject, transaction_date AS first, count(*) OVER w AS n, sum(transaction_amount) OVER w AS s, max(transaction_date) OVER w AS last FROM exits WHERE channel = '{channel}' AND transaction_date IS NOT NULL AND {key} IS NOT NULL
        WINDOW w AS (PARTITION BY {key} ORDER BY epoch(date_trunc('second', transaction_date)) RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING))""",
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, date_trunc('second', first), first, s DESC) AS r FROM seen_{name} WHERE n >= 3) WHERE r = 1)",
    )


_MANY = (
    "days AS (SELECT cash_account AS subject, day, count(DISTINCT atm_id) AS distinct_atms, count(*) AS n, sum(transaction_amount) AS s FROM exits WHERE channel = 'ATM' AND day IS NOT NULL AND has_terminal GROUP BY ALL)",
    "many AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY distinct_atms DESC, day) AS r FROM days WHERE distinct_atms >= 3) WHERE r = 1)",
)
_FLAGS = (*_seen("cash_account", "ATM", "rapid"), *_seen("atm_id", "POS", "shops"), *_MANY)
_MINUTES = "(date_diff('microsecond', first, last) // 60000000)"


@query("exit_flags", on_events(*_FLAGS, select=f"""SELECT 'ATM' AS channel, 'rapid' AS flag, subject, n AS "count", {D('s', 'total_amount')}, n || ' withdrawals in ' || {_MINUTES} || ' min' AS why FROM rapid
 UNION ALL SELECT 'ATM', 'multi_atm', subject, n, s::DOUBLE, distinct_atms || ' different ATMs on ' || day FROM many UNION ALL SELECT 'POS', 'suspicious_merchant', subject, n, s::DOUBLE, n || ' POS txns in ' || {_MINUTES} || ' min' FROM shops"""), events_ledger)
def _(l):
    return behaviour.exit_flags(_legs(l, "day", "payment_mode", "atm_id"))


_WITHIN = "epoch(date_trunc('second', transaction_date)) BETWEEN epoch(date_trunc('second', first)) AND epoch(date_trunc('second', first)) + 3600"


@query("exit_flag_legs", on_events(*_FLAGS, select=f"""SELECT 'ATM' AS channel, 'rapid' AS flag, subject, id, {S('transaction_date')}, {D('transaction_amount')}, 'one of ' || n || ' within 60 min' AS why FROM rapid JOIN exits ON cash_account = subject AND channel = 'ATM' AND {_WITHIN}
 UNION ALL SELECT 'ATM', 'multi_atm', subject, id, transaction_date::VARCHAR, transaction_amount::DOUBLE, 'one day at ' || distinct_atms || ' machines' FROM many JOIN exits ON cash_account = subject AND channel = 'ATM' AND has_terminal AND exits.day = many.day
 UNION ALL SELECT 'POS', 'suspicious_merchant', subject, id, transaction_date::VARCHAR, transaction_amount::DOUBLE, 'one of ' || n || ' within 60 min' FROM shops JOIN exits ON atm_id = subject AND channel = 'POS' AND {_WITHIN}"""), events_ledger)
def _(l):
    return behaviour.flag_legs(_legs(l, "day", "payment_mode", "atm_id"))


@query("exit_view", on_events(select=f"SELECT id, channel, cash_account, atm_id, {S('transaction_date')}, {D('transaction_amount')} FROM exits WHERE channel = 'POS'"), events_ledger)
def _(l):
    rows = _legs(l, "day", "payment_mode", "atm_id")
    return exports.exit_tables(rows, channel="POS")["exits"].select("id", "channel", "cash_account", "atm_id", "transaction_date", "transaction_amount")


@query("exit_view_flags", on_events(*_FLAGS, select=f"""SELECT 'POS' AS channel, 'suspicious_merchant' AS flag, subject, n AS "count", {D('s', 'total_amount')}, n || ' POS txns in ' || {_MINUTES} || ' min' AS why FROM shops"""), events_ledger)
def _(l):
    return exports.exit_tables(_legs(l, "day", "payment_mode", "atm_id"), channel="POS", flag="suspicious_merchant")["flags"]


_SPEED = """got AS (SELECT benef_key AS account_no, min(transaction_date) AS t FROM legs WHERE row_kind = 'HOP' AND transaction_date IS NOT NULL GROUP BY 1),
speed AS (SELECT account_no, date_diff('microsecond', t, min(transaction_date)) // 1000000 / 3600 AS hours FROM got JOIN legs ON cash_account = account_no WHERE row_kind = 'EXIT' AND transaction_date >= t GROUP BY account_no, t)"""


@query("account_speed", on_ledger(_SPEED, select="SELECT account_no, round(hours, 6) AS hours FROM speed"))
def _(l):
    return behaviour.account_speed(_legs(l)).withColumn("hours", F.round("hours", 6))


@query("cashout_speed", on_ledger(_SPEED, select="SELECT count(*) AS account_count, round(median(hours), 4) AS median_hours, CAST(round(sum(CAST(round(hours, 6) AS DECIMAL(20,6))) / count(*), 4) AS DOUBLE) AS mean_hours FROM speed"))
def _(l):
    return behaviour.cashout_speed(_legs(l))


@query("investigation_metrics", on_ledger(ROLLUP, select=f"""SELECT {S("f", "from_date")}, {S("t", "to_date")}, datediff('day', f, t) AS response_gap_days, CASE WHEN datediff('day', f, t) <= 7 THEN 'ok' WHEN datediff('day', f, t) <= 14 THEN 'warn' WHEN t IS NOT NULL THEN 'danger' ELSE 'none' END AS response_gap_severity,
 {D("base_amount")}, {D("on_hold", "secured_amount")}, {PCT("on_hold", "base_amount")} AS recovery_pct, CASE WHEN base_amount <= 0 THEN 'none' WHEN on_hold <= 0 THEN 'danger' WHEN {PCT("on_hold", "base_amount")} < 25 THEN 'warn' ELSE 'ok' END AS recovery_severity
 FROM money, (SELECT min(day) AS f, min(day) FILTER (WHERE row_kind = 'HOLD') AS t FROM legs)"""))
def _(l):
    rows = _legs(l, "day")
    return behaviour.investigation_metrics(rows, rollup(rows))


# -- time and place ----------------------------------------------------------
_DAYS = "days AS (SELECT day, sum(transaction_amount) AS a, count(*) AS n, count(*) FILTER (WHERE row_kind = 'EXIT') AS c FROM legs WHERE day IS NOT NULL GROUP BY day)"


@query("timeline", on_ledger(_DAYS, "parts AS (SELECT day, string_agg(layer_no || '=' || a, '; ' ORDER BY layer_no) AS layer_breakdown FROM (SELECT day, layer_no, sum(transaction_amount) AS a FROM legs WHERE day IS NOT NULL GROUP BY ALL) GROUP BY day)", select=f"SELECT {S('day', 'date')}, {D('a', 'total_amount')}, n AS transaction_count, c AS cashouts, layer_breakdown FROM days JOIN parts USING (day)"))
def _(l):
    days = calendar.timeline(legs(l))
    return days.withColumn("layer_breakdown", F.array_join(F.transform(F.map_entries("layer_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; "))


@query("cumulative_timeline", on_ledger(_DAYS, select=f"SELECT {S('day', 'date')}, {D('a', 'total_amount')}, {D('sum(a) OVER (ORDER BY day)', 'cumulative')} FROM days"))
def _(l):
    return calendar.running_total(calendar.timeline(legs(l)).select("date", "total_amount"))


@query("timeline_summary", on_ledger("b AS (SELECT min(day) AS f, min(day) FILTER (WHERE row_kind = 'EXIT') AS c, min(day) FILTER (WHERE row_kind = 'HOLD') AS h, max(day) AS z FROM legs)", select=f"SELECT {S('f', 'first_fraud_date')}, {S('c', 'first_cashout_date')}, {S('h', 'first_bank_action_date')}, datediff('day', f, z) AS timeline_span_days, datediff('day', f, h) AS fraud_to_bank_action_days FROM b"))
def _(l):
    return calendar.timeline_summary(legs(l))


@query("weekday_breakdown", on_ledger(select=f"""SELECT place, weekday, coalesce(n, 0) AS txns, {D("coalesce(a, 0)", "total_amount")} FROM (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday'), (7, 'Undated')) v(place, weekday))
 LEFT JOIN (SELECT coalesce(isodow(day) - 1, 7) AS place, count(*) AS n, sum(transaction_amount) AS a FROM legs GROUP BY 1) USING (place)"""))
def _(l):
    return calendar.weekdays(legs(l))


@query("hourly_pattern", on_ledger(select=f"SELECT hour, coalesce(n, 0) AS txns, {D('coalesce(a, 0)', 'total_amount')} FROM (SELECT unnest(range(24)) AS hour) LEFT JOIN (SELECT hour(transaction_date) AS hour, count(*) AS n, sum(transaction_amount) AS a FROM flagged WHERE transaction_date IS NOT NULL GROUP BY 1) USING (hour)"))
def _(l):
    return calendar.hours(_flagged(l))


@query("daily_volume", on_ledger(select=f"SELECT {S('day')}, {D('coalesce(sum(transaction_amount) FILTER (WHERE m NOT IN (' + chr(39) + 'ATM' + chr(39) + ', ' + chr(39) + 'POS' + chr(39) + ')), 0)', 'transfer')}, {D('coalesce(sum(transaction_amount) FILTER (WHERE m IN (' + chr(39) + 'ATM' + chr(39) + ', ' + chr(39) + 'POS' + chr(39) + ')), 0)', 'cash')} FROM flagged WHERE day IS NOT NULL GROUP BY flagged.day"))
def _(l):
    return calendar.daily_volume(_flagged(l))


def _place(key: str) -> str:
    return on_ledger(select=f"SELECT {key}, {D('a', 'amount')}, n AS \"count\", c AS cashout_count, {PCT('a', '(SELECT sum(transaction_amount) FROM legs)')} AS pct FROM (SELECT coalesce(nullif(trim({key}), ''), 'Unknown') AS {key}, sum(transaction_amount) AS a, count(*) AS n, count(*) FILTER (WHERE row_kind = 'EXIT') AS c FROM legs GROUP BY 1)")


@query("geography_states", _place("state"))
def _(l):
    return calendar.by_place(legs(l), "state")


@query("geography_cities", _place("city"))
def _(l):
    return calendar.by_place(legs(l), "city")


@query("payment_modes", on_ledger(select=f"SELECT mode, n AS \"count\", {D('a', 'amount')}, {PCT('a', '(SELECT sum(transaction_amount) FROM legs)')} AS share_pct FROM (SELECT coalesce(nullif(m, ''), 'OTHERS') AS mode, count(*) AS n, sum(transaction_amount) AS a FROM legs GROUP BY 1)"))
def _(l):
    return calendar.payment_modes(legs(l))


# -- attribution -------------------------------------------------------------
_WALLETS = attribution.WALLETS.replace("'", "''")
_QUALITY = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY benef_key ORDER BY CASE WHEN bank_source = 'IFSC' THEN 0 WHEN bank_flag = 'UNKNOWN_IFSC_PREFIX' THEN 1 ELSE 2 END, bank_flag IS NULL, id) AS r FROM legs WHERE benef_key <> ''),
quality AS (SELECT benef_key AS account_no, beneficiary_bank AS bank, raw_beneficiary_bank AS raw_bank, ifsc_code, bank_source, bank_flag,
  CASE WHEN bank_flag = 'IFSC_TEXT_MISMATCH' OR (bank_flag = 'NO_IFSC' AND (regexp_matches(trim(beneficiary_bank), '{_WALLETS}') OR beneficiary_bank IN (SELECT beneficiary_bank FROM legs WHERE bank_source = 'IFSC'))) THEN 'informational' ELSE 'actionable' END AS severity,
  list_position(['IFSC_TEXT_MISMATCH', 'UNKNOWN_IFSC_PREFIX', 'INVALID_IFSC', 'NO_IFSC'], bank_flag) AS place FROM ranked WHERE r = 1 AND bank_flag IS NOT NULL)"""


@query("data_quality", on_ledger(_QUALITY, select="SELECT * FROM quality"))
def _(l):
    return attribution.flagged_accounts(_legs(l, *_BANKED)).drop("message")


@query("data_quality_summary", on_ledger(ROLLUP, _QUALITY, select=f"""SELECT *, {PCT("flagged_accounts", "total_accounts")} AS pct_affected, CASE WHEN freeze_target_accounts > 0 THEN 'red' WHEN actionable_accounts > 0 THEN 'amber' ELSE 'green' END AS status FROM (
 SELECT count(*) AS flagged_accounts, count(*) FILTER (WHERE severity = 'actionable') AS actionable_accounts, count(*) FILTER (WHERE bank_flag = 'IFSC_TEXT_MISMATCH') AS auto_corrected, count(*) FILTER (WHERE severity <> 'actionable' AND bank_flag = 'NO_IFSC') AS expected_no_ifsc,
 count(*) FILTER (WHERE severity = 'actionable' AND account_no IN (SELECT account_no FROM liens)) AS freeze_target_accounts, (SELECT count(DISTINCT benef_key) FROM legs WHERE benef_key <> '') AS total_accounts FROM quality)"""))
def _(l):
    rows = _legs(l, *_BANKED)
    return attribution.quality_summary(rows, attribution.flagged_accounts(rows), money.liens(rollup(rows)))


_QUOTED = lambda values: ", ".join(f"'{v}'" for v in values)
_BY_NUMBER = " OR ".join(["contains(number, '@')", *(f"starts_with(number, '{x}')" for x in banks.WALLET_ACCOUNTS)])
_BY_CODE = f"code IN ('NA', 'N/A') OR regexp_matches(code, '{_WALLETS}') OR (starts_with(code, '{banks.WALLET_PREFIX}') AND regexp_matches(code, '{banks.IFSC}'))"
_BY_NAME = f"regexp_matches(name, '{_WALLETS}') AND NOT list_contains(regexp_split_to_array(lower(name), '[^a-z0-9_]+'), 'bank')"
_INSTRUMENT = f"""written AS (SELECT *, upper(trim(account_no)) AS number, upper(trim(coalesce(ifsc_code, ''))) AS code, coalesce(bank_name, '') AS name FROM liens),
instruments AS (SELECT * EXCLUDE (number, code, name), CASE WHEN {_BY_NUMBER} OR {_BY_CODE} OR ({_BY_NAME}) THEN 'wallet' WHEN number IN ({_QUOTED(banks.NO_ACCOUNT)}) OR contains(number, 'XX') THEN 'masked' ELSE 'bank' END AS instrument FROM written)"""


@query("instruments", on_ledger(ROLLUP, _INSTRUMENT, select=f"SELECT account_no, bank_name, instrument, {D('lien_eligible_amount')} FROM instruments"))
def _(l):
    return attribution.with_instrument(money.liens(rollup(legs(l)))).select("account_no", "bank_name", "instrument", "lien_eligible_amount")


@query("letters", on_ledger(ROLLUP, _INSTRUMENT, select=f"SELECT lower(trim(coalesce(bank_name, 'Unknown'))) AS bank_key, min(bank_name) AS bank_name, count(*) AS account_count, {D('sum(lien_eligible_amount)', 'total_amount')} FROM instruments WHERE instrument = 'bank' GROUP BY 1"))
def _(l):
    return attribution.letters(money.liens(rollup(legs(l))))


@query("letter_accounts", on_ledger(ROLLUP, _INSTRUMENT, select=f"SELECT lower(trim(coalesce(bank_name, 'Unknown'))) AS bank_key, bank_name, account_no, {D('lien_eligible_amount')} FROM instruments WHERE instrument = 'bank'"))
def _(l):
    return attribution.letter_accounts(money.liens(rollup(legs(l))))


@query("padded_accounts", on_ledger(select="SELECT benef_key AS account_no, count(DISTINCT trim(beneficiary_account)) AS spellings, min(trim(beneficiary_account)) AS shown FROM legs WHERE benef_key <> '' GROUP BY 1 HAVING count(DISTINCT trim(beneficiary_account)) > 1"))
def _(l):
    return attribution.hidden_twins(legs(l))


# -- browsing ----------------------------------------------------------------
_SHOWN = ["id", "victim_account", "beneficiary_account", "beneficiary_bank", "payment_mode", "layer_no", "city", "transaction_date", "transaction_amount"]
_SHOWN_SQL = f"id, victim_account, beneficiary_account, beneficiary_bank, payment_mode, layer_no, city, {S('transaction_date')}, {D('transaction_amount')}"


@query("ledger_filter", on_ledger(select=f"SELECT {_SHOWN_SQL} FROM flagged WHERE layer_no IN (1, 2, 3) AND beneficiary_bank IN ('HDFC Bank', 'State Bank of India') AND upper(payment_mode) = 'IMPS' AND flagged.transaction_date >= TIMESTAMP '1996-01-01' AND flagged.transaction_date <= TIMESTAMP '1999-12-31' AND flagged.transaction_amount >= 20000"))
def _(l):
    return browse.filtered(_flagged(l), layers=[1, 2, 3], banks=["HDFC Bank", "State Bank of India"], mode="imps", date_from="1996-01-01", date_to="1999-12-31", amount_from=Decimal(20000)).select(_SHOWN)


@query("ledger_search", on_ledger(select=f"SELECT {_SHOWN_SQL} FROM flagged WHERE utr_no ILIKE '%u12%' OR victim_account ILIKE '%u12%' OR beneficiary_account ILIKE '%u12%' OR beneficiary_name ILIKE '%u12%' OR remarks ILIKE '%u12%'"))
def _(l):
    return browse.filtered(_flagged(l), text="u12").select(_SHOWN)


@query("ledger_search_blocks", SQL["ledger_search"])
def _(l):
    return textindex.TextIndex(_flagged(l).select(*{c: 1 for c in (*_SHOWN, *browse.SEARCHED)})).search("u12").select(_SHOWN)


def _one_key(name: str):
    return lambda l: calendar.one_key_tables(stored_legs(l, "day", "payment_mode", "state", "city"))[name]


for _name, _like in {"hours": "hourly_pattern", "weekdays": "weekday_breakdown", "states": "geography_states", "cities": "geography_cities", "payment_modes": "payment_modes", "daily_volume": "daily_volume"}.items():
    query(f"one_pass_{_name}", SQL[_like])(_one_key(_name))


@query("ledger_page", on_ledger(select=f"SELECT {_SHOWN_SQL} FROM flagged ORDER BY flagged.transaction_amount DESC, id DESC LIMIT 50 OFFSET 50"))
def _(l):
    return browse.page(_flagged(l), 2, 50, by="transaction_amount").select(_SHOWN)


@query("ledger_last_page", on_ledger(select=f"SELECT {_SHOWN_SQL} FROM flagged ORDER BY flagged.transaction_amount DESC, id DESC LIMIT 50 OFFSET (SELECT (count(*) - 1) // 50 * 50 FROM flagged)"))
def _(l):
    index = pages.RankIndex(_flagged(l).select(_SHOWN), by="transaction_amount")
    return index.page(index.pages(50), 50)


@query("page_counts", on_ledger(select="SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM flagged"))
def _(l):
    return browse.page_counts(_flagged(l))


@query("bank_facet", on_ledger(select="SELECT beneficiary_bank, count(*) AS \"count\" FROM flagged WHERE trim(beneficiary_bank) <> '' GROUP BY 1"))
def _(l):
    return browse.bank_facet(_flagged(l))


@query("layer_facet", on_ledger(select="SELECT layer_no, count(*) AS \"count\" FROM flagged GROUP BY 1"))
def _(l):
    return browse.layer_facet(_flagged(l))


@query("account_detail", on_ledger(select=f"SELECT id, CASE WHEN benef_key = '10' THEN 'in' ELSE 'out' END AS direction, CASE WHEN benef_key = '10' THEN victim_key ELSE benef_key END AS counterparty, {S('transaction_date')}, {D('transaction_amount')}, {D('disputed_amount')}, payment_mode, layer_no, is_duplicate FROM flagged WHERE benef_key = '10' OR victim_key = '10'"))
def _(l):
    return browse.account_legs(_flagged(l), "10")


@query("drill_down", on_ledger(select=f"SELECT 'Account 10' AS title, count(*) AS legs, {D('coalesce(sum(transaction_amount), 0)', 'amount')}, {D('coalesce(sum(disputed_amount), 0)', 'disputed')}, {S('min(day)', 'first_day')}, {S('max(day)', 'last_day')} FROM flagged WHERE benef_key = '10' OR victim_key = '10'"))
def _(l):
    return exports.drill_down(browse.account_legs(_flagged(l), "10").withColumn("day", F.to_date("transaction_date")), "Account 10")["figures"]


@query("terminal_detail", on_ledger(select=f"SELECT {_SHOWN_SQL} FROM flagged WHERE row_kind = 'EXIT' AND trim(coalesce(atm_id, '')) = ''"))
def _(l):
    return browse.terminal_legs(_flagged(l), "UNKNOWN_ATM").select(_SHOWN)


@query("edge_detail", on_ledger(EDGES, select=f"SELECT {_SHOWN_SQL} FROM legs WHERE row_kind = 'HOP' AND victim_key = '1' AND benef_key IN (SELECT destination FROM edges WHERE source = '1' ORDER BY destination LIMIT 1)"))
def _(l):
    rows = _legs(l, *_SHOWN)
    first = rows.where("row_kind = 'HOP' AND victim_key = '1'").agg(F.min("benef_key")).scalar()
    return browse.edge_legs(rows, F.lit("1"), first).select(_SHOWN)


@query("bank_detail", on_ledger(select=f"SELECT {_SHOWN_SQL} FROM flagged WHERE beneficiary_bank = 'ICICI Bank'"))
def _(l):
    return browse.bank_legs(_flagged(l), "ICICI Bank").select(_SHOWN)


@query("day_detail", on_ledger(select=f"SELECT {_SHOWN_SQL} FROM legs WHERE day = DATE '1997-03-03'"))
def _(l):
    return browse.day_legs(legs(l), "1997-03-03").select(_SHOWN)


_FIELDS = "report_id ack_no complaint_date victim_account victim_bank beneficiary_account raw_beneficiary_bank beneficiary_name ifsc_code transaction_date transaction_amount disputed_amount utr_no payment_mode layer_no atm_id atm_location city state remarks bank_source bank_flag beneficiary_bank victim_key benef_key row_kind cashout_mode cash_account day is_duplicate".split()


@query("leg_detail", on_ledger(f"one AS (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _FIELDS)} FROM flagged WHERE id = (SELECT min(id) FROM flagged))", select=f"SELECT field, value FROM (UNPIVOT one ON {', '.join(_FIELDS)} INTO NAME field VALUE value) WHERE trim(value) <> ''"))
def _(l):
    rows = stored(_flagged(l))
    return browse.leg_fields(rows, rows.agg(F.min("id")).scalar())


@query("merchants", on_ledger(select=f"SELECT coalesce(nullif(trim(atm_location), ''), nullif(trim(beneficiary_name), ''), 'UNKNOWN_MERCHANT') AS name, coalesce(nullif(trim(atm_id), ''), '—') AS terminal_id, {D('sum(transaction_amount)', 'amount')}, count(*) AS txn_count FROM flagged WHERE m = 'POS' GROUP BY 1, 2"))
def _(l):
    return browse.merchants(_flagged(l))


@query("atm_terminals", on_events(select=f"SELECT atm_id, {D('sum(transaction_amount)', 'amount')}, count(*) AS \"count\" FROM legs WHERE row_kind = 'EXIT' AND has_terminal GROUP BY atm_id HAVING NOT (count(*) FILTER (WHERE m = 'POS') > 0 AND count(*) FILTER (WHERE m = 'ATM') = 0)"), events_ledger)
def _(l):
    return browse.atm_terminals(legs(l))


@query("accounts_per_terminal", on_ledger(select="SELECT atm_id, count(DISTINCT cash_account) AS accounts FROM flagged WHERE has_terminal AND cash_account <> '' GROUP BY 1"))
def _(l):
    return browse.accounts_per_terminal(_flagged(l))


@query("bank_rankings", on_ledger(ROLLUP, select=f"SELECT bank_name, count(*) AS accounts, {D('sum(lien_eligible_amount)', 'lien_total')}, coalesce(any_value(n), 0) AS legs FROM liens LEFT JOIN (SELECT beneficiary_bank, count(*) AS n FROM legs GROUP BY 1) ON beneficiary_bank = bank_name WHERE trim(bank_name) <> '' GROUP BY 1"))
def _(l):
    rows = _legs(l)
    return browse.bank_rankings(money.liens(rollup(rows)), rows)


# -- registry ----------------------------------------------------------------
_CONTRIB = "contributed AS (SELECT benef_key AS account_no, report_id, arg_min(beneficiary_bank, id) FILTER (WHERE trim(beneficiary_bank) <> '') AS bank_name, sum(transaction_amount) AS amount_passed FROM legs WHERE row_kind = 'HOP' GROUP BY 1, 2)"
_REGISTRY = lambda source: f"SELECT account_no, arg_min(bank_name, report_id) FILTER (WHERE bank_name IS NOT NULL) AS bank_name, min(report_id) AS first_seen_report_id, count(*) AS appearance_count, {D('sum(amount_passed)', 'total_amount_passed')} FROM {source} GROUP BY 1"


@query("repeat_accounts", on_ledger(_CONTRIB, select=_REGISTRY("contributed")))
def _(l):
    return registry.aggregate(registry.contributions(legs(l)))


_CHANGED = "(SELECT * FROM contributed WHERE report_id NOT IN (3, 5) UNION ALL SELECT account_no, 3, min(bank_name), sum(amount_passed) FROM contributed WHERE report_id = 4 GROUP BY account_no)"


@query("registry_view", on_ledger(_CONTRIB, select=_REGISTRY(_CHANGED)))
def _(l):
    # all reports, then one replaced by another's accounts and one withdrawn
    view = RegistryView(VersionedStore(l.sparkSession, f"{kept_dir(l.sparkSession)}/registry-{uuid.uuid4().hex}"))
    view.load(registry.contributions(legs(l)))
    view.apply(3, view.contributions().where("report_id = 4").drop("report_id"), "other")
    view.withdraw(5)
    return view.read()


@query("liens_stored", on_ledger(ROLLUP, select=f"SELECT account_no, CASE WHEN total_on_hold > 0 THEN 'applied' ELSE 'pending' END AS status, {D('lien_eligible_amount')} FROM liens"))
def _(l):
    # pending for all, then news on some, twice
    store = VersionedStore(l.sparkSession, f"{kept_dir(l.sparkSession)}/liens-{uuid.uuid4().hex}")
    lien_rows = stored(money.liens(rollup(legs(l))).select("account_no", "total_on_hold", "lien_eligible_amount"))
    store_upsert(store, "liens", lien_rows.select("account_no", F.lit("pending").alias("status"), "lien_eligible_amount"), ["account_no"], "liens", "first")
    news = lien_rows.where("total_on_hold > 0").select("account_no", F.lit("applied").alias("status"), F.lit(None).cast("decimal(18,2)").alias("lien_eligible_amount"))
    for _ in range(2):
        store_upsert(store, "liens", news, ["account_no"], "liens", "news")
    return store.read("liens")


@query("registry_orphans", on_ledger(_CONTRIB, select=f"SELECT * FROM ({_REGISTRY('contributed')}) r WHERE account_no NOT IN (SELECT benef_key FROM legs WHERE report_id <> 3)"))
def _(l):
    rows = _legs(l, "report_id")
    return registry.orphans(registry.aggregate(registry.contributions(rows)), rows.where("report_id <> 3"))


@query("repeat_accounts_withdrawn", on_ledger(_CONTRIB, select=_REGISTRY("(SELECT * FROM contributed WHERE report_id <> 3)")))
def _(l):
    return registry.aggregate(registry.withdraw_report(registry.contributions(legs(l)), 3))


@query("repeat_accounts_replaced", on_ledger(_CONTRIB, select=_REGISTRY("(SELECT * FROM contributed WHERE report_id <> 3 UNION ALL SELECT account_no, 3, min(bank_name), sum(amount_passed) FROM contributed WHERE report_id = 4 GROUP BY account_no)")))
def _(l):
    all_of = stored(registry.contributions(legs(l)))
    return registry.aggregate(registry.replace_report(all_of, 3, all_of.where("report_id = 4")))


# -- scores and words --------------------------------------------------------
_CLIP = lambda x: f"greatest(least({x}, 1.0), 0.0)"
_POINTS = {
    "pass_through": (30, _CLIP("coalesce(ratio, 0.0) / 0.9")),
    "cashout_speed": (20, f"coalesce({_CLIP('(24.0::DOUBLE - hours) / 23.0')}, 0.0)"),
    "txn_count": (15, _CLIP("log2(1.0::DOUBLE + txn_count) / log2(21.0::DOUBLE)")),
    "cross_case": (20, _CLIP("(cases - 1) / 2.0::DOUBLE")),
    "geo_spread": (10, _CLIP("(places - 1) / 3.0::DOUBLE")),
    "kyc_variance": (5, _CLIP("(names - 1) / 2.0::DOUBLE")),
    "both_sheets": (18, "CASE WHEN hops_in > 0 AND total_cashed_out > 0 THEN 1.0 ELSE 0.0 END"),
    "multi_channel": (8, "CASE WHEN channels >= 2 THEN 1.0 ELSE 0.0 END"),
    "fan_in": (8, _CLIP("(distinct_senders - 1) / 2.0::DOUBLE")),
    "high_cashout_ratio": (15, "CASE WHEN total_received > 0 AND CAST(total_cashed_out AS DOUBLE) / CAST(total_received AS DOUBLE) >= 0.8 THEN 1.0 ELSE 0.0 END"),
    "same_day_in_out": (17, "CASE WHEN same_day THEN 1.0 ELSE 0.0 END"),
    "in_degree_collector": (6, "CASE WHEN distinct_senders >= 3 THEN 1.0 ELSE 0.0 END"),
}
_SCORES = f"""
seen AS (SELECT account_no, count(DISTINCT ack_no) AS cases, count(DISTINCT city) FILTER (WHERE role <> 'out' AND trim(city) <> '') AS places, count(DISTINCT lower(beneficiary_name)) FILTER (WHERE role <> 'out' AND trim(beneficiary_name) <> '') AS names,
  count(DISTINCT upper(payment_mode)) FILTER (WHERE row_kind = 'EXIT') AS channels, min(day) FILTER (WHERE role = 'in') AS first_day, min(day) FILTER (WHERE row_kind = 'EXIT') AS first_cash_day
  FROM (SELECT * FROM touches UNION ALL SELECT cash_account, 'other', * FROM legs WHERE row_kind = 'OTHER') GROUP BY account_no),
parts AS (SELECT accounts.*, cases, places, names, channels, coalesce(first_day = first_cash_day, false) AS same_day, hours,
  CASE WHEN disputed_received > 0 THEN round(CAST(total_forwarded AS DOUBLE) / CAST(disputed_received AS DOUBLE), 4) END AS ratio
  FROM accounts JOIN seen USING (account_no) LEFT JOIN speed USING (account_no) WHERE hops_in > 0),
points AS (SELECT *, {", ".join(f"round(CAST({w} * ({c}) AS DOUBLE), 3) AS points_{k}" for k, (w, c) in _POINTS.items())} FROM parts),
scores AS (SELECT *, CAST(floor({" + ".join(f"points_{k}" for k in _POINTS)} + 0.5) AS INT) AS mule_score FROM points),
scored AS (SELECT *, CASE WHEN mule_score >= 70 THEN 'HIGH' WHEN mule_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label FROM scores)"""
_CONDUIT = "risk_label IN ('HIGH', 'MEDIUM') AND disputed_received < 10000 AND greatest(total_received, onward_forwarded, total_cashed_out, total_forwarded) >= 100000"


@query("mule_scores", on_ledger(ROLLUP, _SPEED, _SCORES, select=f"SELECT account_no, bank_name, layer_no, mule_score, risk_label, ratio AS pass_through_ratio, cases, places, channels, same_day, {_CONDUIT} AS gross_conduit, CASE WHEN distinct_senders >= 5 THEN 'danger' WHEN distinct_senders >= 3 THEN 'warn' END AS aggregator_severity, {', '.join(f'points_{k}' for k in _POINTS)} FROM scored"))
def _(l):
    rows = _legs(l, *_SCORED)
    return scoring.score(rows, rollup(rows)).select("account_no", "bank_name", "layer_no", "mule_score", "risk_label", "pass_through_ratio", "cases", "places", "channels", "same_day", "gross_conduit", "aggregator_severity", *[f"points_{k}" for k in scoring.WEIGHTS])


_SAYS = {
    "pass_through": "'Passes on ' || CAST(round(ratio * 100, 0) AS BIGINT) || '% of what is traced'",
    "cashout_speed": "'Cashes out within ' || round(hours, 1) || ' hours'",
    "cross_case": "'Appears in ' || cases || ' cases'",
    "same_day_in_out": "'Receives and cashes out on one day'",
    "in_degree_collector": "'High fan-in collector: in-degree ' || distinct_senders",
}
_REASONS = ", ".join(f"CASE WHEN points_{k} > 0 THEN {v} || ' (+' || CAST(round(points_{k}, 0) AS INT) || ')' END" for k, v in _SAYS.items())


@query("mule_reasons", on_ledger(ROLLUP, _SPEED, _SCORES, select=f"SELECT account_no, mule_score, array_to_string(list_filter([{_REASONS}], lambda x: x IS NOT NULL), '; ') AS suspicion_reasons FROM scored"))
def _(l):
    rows = _legs(l, *_SCORED)
    return scoring.score(rows, rollup(rows)).select("account_no", "mule_score", "suspicion_reasons")


@query("mule_list", on_ledger(ROLLUP, _SPEED, _SCORES, select=f"SELECT account_no, bank_name, layer_no, mule_score, {D('total_received')} FROM scored WHERE risk_label = 'HIGH' AND layer_no IN (1, 2) AND bank_name ILIKE '%bank%' AND scored.total_received BETWEEN 100000 AND 5000000"))
def _(l):
    rows = _legs(l, *_SCORED)
    return browse.risk_list(scoring.score(rows, rollup(rows)), risk="HIGH", layers=[1, 2], text="bank", received_from=Decimal(100000), received_to=Decimal(5000000)).select("account_no", "bank_name", "layer_no", "mule_score", "total_received")


@query("risk_counts", on_ledger(ROLLUP, _SPEED, _SCORES, select="SELECT count(*) FILTER (WHERE risk_label = 'HIGH') AS high, count(*) FILTER (WHERE risk_label = 'MEDIUM') AS medium, count(*) FILTER (WHERE risk_label = 'LOW') AS low FROM scored"))
def _(l):
    rows = _legs(l, *_SCORED)
    return scoring.risk_counts(scoring.score(rows, rollup(rows)))


@query("layer_detail", on_ledger(ROLLUP, _SPEED, _SCORES, select="SELECT account_no, mule_score, risk_label, layer_no FROM scored WHERE layer_no = 2"))
def _(l):
    rows = _legs(l, *_SCORED)
    return browse.layer_accounts(scoring.score(rows, rollup(rows)), 2).select("account_no", "mule_score", "risk_label", "layer_no")


@query("peak_layer", on_ledger(_LAYERS, select="SELECT arg_max(layer_no, account_count) AS peak_layer, max(account_count) AS accounts FROM base"))
def _(l):
    return graph.layers(_legs(l, "ack_no")).agg(F.max_by("layer_no", "account_count").alias("peak_layer"), F.max("account_count").alias("accounts"))


@query("cashout_reconciliation", on_ledger(ROLLUP, select=f"""SELECT {D("(SELECT sum(transaction_amount) FROM flagged WHERE row_kind = 'EXIT')", "gross_shown")}, {D("(SELECT coalesce(sum(transaction_amount), 0) FROM flagged WHERE row_kind = 'EXIT' AND is_duplicate)", "dup_amount_shown")},
 {D("(SELECT sum(cashed - capped) FROM capped)", "cap_excess")}, {D("(SELECT sum(capped) FROM capped)", "confirmed")}"""))
def _(l):
    flagged = stored_legs(l)
    return money.cashout_reconciliation(flagged, rollup(flagged.where("NOT is_duplicate")))


@query("badges", on_ledger(ROLLUP, _SPEED, _SCORES, _QUALITY, select="SELECT (SELECT count(*) FROM scored WHERE risk_label = 'HIGH') AS high_risk, (SELECT count(*) FROM quality) AS bank_flags"))
def _(l):
    rows = _legs(l, *_SCORED, *_BANKED)
    return one_row(scoring.score(rows, rollup(rows)).agg(F.count_if(F.col("risk_label") == "HIGH").alias("high_risk")), attribution.flagged_accounts(rows).agg(F.count("*").alias("bank_flags")))


@query("audit_tail", on_ledger(select=f"SELECT id, {S('complaint_date', 'logged_at')} FROM flagged ORDER BY flagged.complaint_date DESC, id DESC LIMIT 100"))
def _(l):
    return registry.newest(_flagged(l).select("id", F.col("complaint_date").alias("logged_at")))


@query("earlier_sources", on_ledger("reports AS (SELECT DISTINCT ack_no, report_id, 'h' || (report_id % 3) AS source_sha256 FROM flagged)", select="SELECT DISTINCT a.ack_no, a.source_sha256, b.source_sha256 AS earlier_sha256 FROM reports a JOIN reports b ON a.ack_no = b.ack_no AND b.report_id < a.report_id AND a.source_sha256 <> b.source_sha256"))
def _(l):
    return registry.earlier_sources(stored(l.select("ack_no", "report_id", F.concat(F.lit("h"), F.col("report_id") % 3).alias("source_sha256")).distinct()))


@query("weak_duplicates", on_ledger(select=f"SELECT utr_no, beneficiary_account, {D('transaction_amount')}, {S('transaction_date')}, count(*) AS n FROM flagged WHERE utr_no IS NOT NULL AND beneficiary_account IS NOT NULL GROUP BY utr_no, beneficiary_account, flagged.transaction_amount, flagged.transaction_date HAVING count(*) > 1"))
def _(l):
    return ingest.weak_duplicates(_flagged(l))


# -- cells to values: texts as exports write them, and what they stand for ----
@query("parsed_amounts", on_ledger(select=f"SELECT id, {D('CASE id % 5 WHEN 3 THEN -transaction_amount WHEN 4 THEN 0 ELSE transaction_amount END', 'amount')} FROM flagged"))
def _(l):
    v = F.col("transaction_amount").cast("string")
    k = F.col("id") % 5
    cell = F.when(k == 0, F.concat(F.lit("Rs. "), v)).when(k == 1, F.concat(F.lit("₹ "), F.format_number(F.col("transaction_amount"), 2), F.lit("/-"))).when(k == 2, F.concat(F.lit(" INR "), v)).when(k == 3, F.concat(F.lit("("), v, F.lit(")"))).otherwise(F.concat(v, F.lit(" Cr")))
    return _flagged(l).select("id", parse.parse_amount(cell).alias("amount"))


@query("parsed_dates", on_ledger(select=f"SELECT id, {S('CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 2 THEN CAST(day AS TIMESTAMP) ELSE transaction_date END', 'at')} FROM flagged"))
def _(l):
    t = F.col("transaction_date")
    k = F.col("id") % 4
    cell = F.when(k == 0, F.date_format(t, "dd/MM/yyyy hh:mm:ss a")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")).when(k == 2, F.datediff(t, F.lit("1899-12-30")).cast("string")).otherwise(F.date_format(t, "'31/02/'yyyy"))
    return _flagged(l).select("id", parse.parse_date(cell).alias("at"))


@query("account_labels", on_ledger(select="SELECT id, repeat('•', CAST(least(greatest(length(trim(beneficiary_account)) - 4, 0), 8) AS INT)) || right(trim(beneficiary_account), 4) AS masked FROM flagged"))
def _(l):
    return _flagged(l).select("id", text.masked_account(F.col("beneficiary_account")).alias("masked"))


_FIXED = lambda e: f"CAST(CAST(abs({e}) AS DECIMAL(18,2)) AS VARCHAR)"
_UNITS = lambda e: f"split_part({_FIXED(e)}, '.', 1)"
_RUPEES = lambda e: f"""(CASE WHEN {e} < 0 THEN '-Rs. ' ELSE 'Rs. ' END || CASE WHEN length({_UNITS(e)}) > 3 THEN ltrim(reverse(regexp_replace(reverse({_UNITS(e)}[1:length({_UNITS(e)}) - 3]), '([0-9][0-9])', '\\1,', 'g')), ',') || ',' || right({_UNITS(e)}, 3) ELSE {_UNITS(e)} END || '.' || split_part({_FIXED(e)}, '.', 2))"""
_FIGURES = f"""figures AS (SELECT (SELECT base_amount FROM money) AS loss, (SELECT cashed_out FROM money) AS cash, (SELECT on_hold FROM money) AS hold, (SELECT {_RECOVERABLE} FROM money) AS rest, (SELECT sum(lien_eligible_amount) FROM accounts) AS lien,
 (SELECT count(DISTINCT layer_no) FROM legs WHERE row_kind = 'HOP') AS depth, (SELECT count(*) FROM flagged WHERE is_duplicate) AS again, (SELECT count(*) FROM scored WHERE risk_label = 'HIGH') AS high, (SELECT count(*) FROM scored WHERE risk_label = 'MEDIUM') AS medium)"""


@query("key_findings", on_ledger(ROLLUP, _SPEED, _SCORES, _FIGURES, select=f"""SELECT 0 AS place, 'Victims lost ' || {_RUPEES('loss')} || ' over ' || depth || ' layers.' AS finding FROM figures UNION ALL SELECT 1, 'Cashed out: ' || {_RUPEES('cash')} || '; on hold: ' || {_RUPEES('hold')} || '.' FROM figures
 UNION ALL SELECT 2, 'Still recoverable: ' || {_RUPEES('rest')} || '; liens could take ' || {_RUPEES('lien')} || '.' FROM figures UNION ALL SELECT 3, high || ' accounts of high and ' || medium || ' of medium risk.' FROM figures
 UNION ALL SELECT 4, again || ' repeated legs were set apart.' FROM figures"""))
def _(l):
    flagged = stored_legs(l, *_SCORED)
    rows = flagged.where("NOT is_duplicate")
    accounts = cut(rollup(rows))
    return findings.key_findings(money.summary(flagged, accounts), scoring.risk_counts(scoring.score(rows, accounts)))


@query("roadmap", on_ledger(ROLLUP, _SPEED, _SCORES, _QUALITY, _FIGURES, "doubt AS (SELECT count(*) AS n FROM quality WHERE severity = 'actionable' AND account_no IN (SELECT account_no FROM liens))", select=f"""SELECT * FROM (
 SELECT 'P0' AS priority, 'Place liens' AS title, CASE WHEN lien > 0 THEN 'Balances of ' || {_RUPEES('lien')} || ' can be held now.' END AS description FROM figures
 UNION ALL SELECT 'P0', 'Confirm banks of lien targets', CASE WHEN n > 0 THEN n || ' lien targets have doubtful banks.' END FROM doubt UNION ALL SELECT 'P1', 'Examine accounts of high risk', CASE WHEN high > 0 THEN high || ' accounts score high.' END FROM figures
 UNION ALL SELECT 'P2', 'Ask for footage of cash exits', CASE WHEN cash > 0 THEN {_RUPEES('cash')} || ' left as cash.' END FROM figures UNION ALL SELECT 'P3', 'Check repeated legs', CASE WHEN again > 0 THEN again || ' legs are listed more than once.' END FROM figures) WHERE description IS NOT NULL"""))
def _(l):
    flagged = stored_legs(l, *_SCORED, *_BANKED)
    rows = flagged.where("NOT is_duplicate")
    accounts = cut(rollup(rows))
    quality = attribution.quality_summary(rows, attribution.flagged_accounts(rows), money.liens(accounts))
    return findings.roadmap(money.summary(flagged, accounts), scoring.risk_counts(scoring.score(rows, accounts)), quality)


_BARE = "list_transform(string_split_regex(upper(remarks), '[^A-Z]+'), lambda w: CASE WHEN w[1:2] IN ('DR', 'CR') THEN w[3:] ELSE w END)"


@query("payment_rails", on_ledger(select=f"SELECT id, list_filter({_BARE}, lambda w: w IN ({_QUOTED(parse.RAILS)}))[1] AS rail FROM flagged"))
def _(l):
    return _flagged(l).select("id", parse.payment_rail(F.col("remarks")).alias("rail"))


_WHOLE, _HEAD = "split_part(CAST(transaction_amount AS VARCHAR), '.', 1)", "CAST(transaction_amount AS VARCHAR)"


@query("money_labels", on_ledger(select=f"""SELECT id, 'Rs. ' || CASE WHEN length({_WHOLE}) > 3 THEN ltrim(reverse(regexp_replace(reverse({_WHOLE}[1:length({_WHOLE}) - 3]), '([0-9][0-9])', '\\1,', 'g')), ',') || ',' || right({_WHOLE}, 3) ELSE {_WHOLE} END || '.' || split_part({_HEAD}, '.', 2) AS label FROM flagged"""))
def _(l):
    return _flagged(l).select("id", text.indian_money(F.col("transaction_amount")).alias("label"))


@query("report_gap", on_ledger(select="SELECT datediff('day', min(day), DATE '2003-01-01') AS days FROM legs"))
def _(l):
    return calendar.report_gap(legs(l), "2003-01-01")


@query("lien_statuses", on_ledger(ROLLUP, select="SELECT account_no, CASE WHEN total_on_hold > 0 THEN 'applied' ELSE 'pending' END AS status, 'first list' AS remarks FROM liens"))
def _(l):
    lien_rows = stored(money.liens(rollup(legs(l))))
    first = lien_rows.select("account_no", F.lit("pending").alias("status"), F.lit("first list").alias("remarks"))
    news = lien_rows.where("total_on_hold > 0").select("account_no", F.lit("applied").alias("status"), F.lit(None).cast("string").alias("remarks"))
    return registry.upsert(first, news, ["account_no"])


_STATUS = "CASE WHEN total_on_hold > 0 THEN 'applied' WHEN total_cashed_out > 0 THEN 'success' ELSE 'pending' END"


@query("lien_status_sums", on_ledger(ROLLUP, f"said AS (SELECT lien_eligible_amount AS a, {_STATUS} AS status FROM liens)", select=f"SELECT {D('sum(a)', 'eligible')}, {D("coalesce(sum(a) FILTER (WHERE status = 'applied'), 0)", 'applied')}, {D("coalesce(sum(a) FILTER (WHERE status = 'success'), 0)", 'success')}, round(coalesce(sum(a) FILTER (WHERE status = 'success'), 0)::DOUBLE / sum(a)::DOUBLE, 6) AS recovery_rate FROM said"))
def _(l):
    return registry.lien_status_sums(money.liens(rollup(legs(l))).withColumn("status", F.expr(_STATUS)))


@query("lien_updates", on_ledger(ROLLUP, "firsts AS (SELECT report_id, benef_key AS account_no, arg_min(beneficiary_bank, id) FILTER (WHERE trim(beneficiary_bank) <> '') AS b, arg_min(ifsc_code, id) FILTER (WHERE ifsc_code IS NOT NULL) AS c FROM legs WHERE benef_key <> '' GROUP BY 1, 2)",
 select="SELECT report_id, account_no, CASE WHEN report_id = 2 THEN 'stored' ELSE b END AS bank_name, CASE WHEN report_id = 2 THEN NULL ELSE c END AS ifsc_code, CASE report_id WHEN 1 THEN 'applied' WHEN 2 THEN CASE WHEN length(account_no) % 2 = 0 THEN 'applied' ELSE 'success' END ELSE 'pending' END AS status, CASE WHEN report_id = 2 THEN 'old' ELSE 'new' END AS remarks, CASE report_id WHEN 1 THEN '2024-01-02 00:00:00' WHEN 2 THEN CASE WHEN length(account_no) % 2 = 0 THEN '2024-01-02 00:00:00' END END AS applied_date FROM firsts WHERE report_id IN (1, 2, 3)"))
def _(l):
    rows = _legs(l, "report_id")
    accounts = rows.where("benef_key <> '' AND report_id IN (1, 2, 3)").select("report_id", F.col("benef_key").alias("account_no")).distinct()
    stored = accounts.where("report_id = 2").selectExpr("report_id", "account_no", "'stored' AS bank_name", "CAST(NULL AS STRING) AS ifsc_code", "'pending' AS status", "'old' AS remarks", "CAST(NULL AS TIMESTAMP_NTZ) AS applied_date")
    news = accounts.selectExpr("report_id", "account_no", "CASE WHEN report_id = 1 OR report_id = 2 AND length(account_no) % 2 = 0 THEN 'applied' WHEN report_id = 2 THEN 'success' END AS status", "CASE WHEN report_id <> 2 THEN 'new' END AS remarks")
    return registry.update_liens(stored, news, rows, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))


@query("bank_options", on_ledger(select="SELECT DISTINCT beneficiary_bank FROM legs WHERE trim(beneficiary_bank) <> ''"))
def _(l):
    return registry.options(legs(l), "beneficiary_bank")


_LINES = "letter_lines AS (SELECT lower(trim(coalesce(bank_name, 'Unknown'))) AS bank_key, count(*) AS n, sum(lien_eligible_amount) AS total_amount FROM instruments WHERE instrument = 'bank' GROUP BY 1)"


@query("letters_diff", on_ledger(ROLLUP, _INSTRUMENT, _LINES, select=f"""SELECT bank_key, {D('total_amount')}, CASE WHEN bank_key = 'hdfc bank' THEN 2 * n WHEN bank_key LIKE '%bank%' THEN 0 ELSE n END AS changed_accounts,
 CASE WHEN bank_key LIKE '%bank%' AND bank_key <> 'hdfc bank' THEN 'sent' ELSE 'draft' END AS status FROM letter_lines UNION ALL SELECT 'closed bank', 1.0, 1, 'withdrawn'"""))
def _(l):
    # what was sent: the same lines to banks, but one bank's under other numbers, and other amounts to the rest
    fresh = stored(attribution.letter_accounts(money.liens(rollup(legs(l)))).select("bank_key", "account_no", "lien_eligible_amount"))
    other = F.when(F.col("bank_key") == "hdfc bank", F.concat(F.lit("old-"), "account_no")).otherwise(F.col("account_no"))
    sent = fresh.select("bank_key", other.alias("account_no"), F.when(F.col("bank_key").contains("bank"), F.col("lien_eligible_amount")).otherwise(F.lit(0).cast("decimal(18,2)")).alias("lien_eligible_amount"))
    gone = fresh.sparkSession.createDataFrame([("closed bank", "1", Decimal(1))], "bank_key string, account_no string, lien_eligible_amount decimal(18,2)")
    return attribution.letters_to_send(fresh, sent.unionByName(gone).withColumn("status", F.lit("sent")))


@query("report_deleted", on_ledger(_CONTRIB, select="SELECT 'contributions' AS name, count(*) AS rows FROM contributed WHERE report_id <> 2 UNION ALL SELECT 'transactions', count(*) FROM flagged WHERE report_id <> 2 UNION ALL SELECT 'audit_log', count(*) FROM flagged WHERE is_duplicate"))
def _(l):
    flagged = stored_legs(l, "report_id")
    tables = registry.delete_report({"transactions": flagged, "contributions": registry.contributions(flagged.where("NOT is_duplicate")), "audit_log": flagged.where("is_duplicate")}, 2)
    out = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- ingestion: the ledger as cells of workbooks, and what is read from them ----
_SHEETED = """sheeted AS (
  SELECT *, r0 + CAST(id % 1000 AS INT) AS r, k = 3 AND sheet_no = 2 AS is_old,
         CASE WHEN k = 3 AND sheet_no = 2 THEN 'Old Transaction' WHEN k = 1 AND sheet_no = 3 THEN 'Sheet 7' WHEN k = 2 AND sheet_no = 4 THEN 'Sheet 8' WHEN k = 4 AND sheet_no = 4 THEN 'Transacton put on hld'
              ELSE ['Money Transfer to', 'Withdrawal through ATM', 'Withdrawal through POS', 'AEPS', 'Put on hold'][sheet_no + 1] END AS sheet,
         CASE WHEN k = 3 AND sheet_no = 2 THEN 'OLD_TRANSACTION' WHEN (k, sheet_no) IN ((1, 3), (2, 4)) THEN 'OTHER' ELSE ['TRANSFER', 'ATM', 'POS', 'AEPS', 'HOLD'][sheet_no + 1] END AS category,
         CASE (k, sheet_no) WHEN (0, 0) THEN 'REQUIRED_COLUMN_MISSING' WHEN (1, 3) THEN 'UNKNOWN_CHANNEL' WHEN (2, 4) THEN 'ZERO_AMOUNTS' END AS problem
  FROM (SELECT *, id // 1000 AS o, id // 100000 AS file, 'case-' || (id // 100000) || '.xlsx' AS path, id // 100000 % 5 AS k, CAST(2 + id // 1000 % 100 * 1000 AS INT) AS r0,
               CASE payment_mode WHEN 'ATM' THEN 1 WHEN 'POS' THEN 2 WHEN 'AEPS' THEN 3 WHEN 'HOLD' THEN 4 ELSE 0 END AS sheet_no
        FROM named WHERE id % 1000 < 500))"""
_TERMINAL = "payment_mode IN ('ATM', 'POS') AND NOT is_old"
_REMARKS = "remarks || CASE WHEN atm_id IS NULL THEN '' ELSE ' // Terminal ID : ' || atm_id || ' // Card acceptor name: ' || atm_location END"
_T = lambda c: f"CASE WHEN sheet_no = 0 THEN nullif(trim({c}), '') END AS {c}"
_NAMED_BANK = "sheet_no = 0 AND (nullif(trim(raw_beneficiary_bank), '') IS NOT NULL OR nullif(trim(ifsc_code), '') IS NOT NULL)"
_TYPED = f"""path, sheet, r, category, ack_no, victim_account, {_T('victim_bank')}, CASE WHEN sheet_no = 0 THEN beneficiary_account ELSE victim_account END AS beneficiary_account, {_T('raw_beneficiary_bank')}, {_T('ifsc_code')},
 CASE WHEN {_NAMED_BANK} THEN beneficiary_bank END AS beneficiary_bank, CASE WHEN {_NAMED_BANK} THEN bank_flag END AS bank_flag, {S('transaction_date')}, {D('transaction_amount')}, {D('CASE WHEN sheet_no = 0 THEN disputed_amount ELSE 0 END', 'disputed_amount')},
 {_T('utr_no')}, CASE WHEN NOT is_old THEN payment_mode END AS payment_mode, layer_no, CASE WHEN {_TERMINAL} THEN atm_id END AS atm_id, CASE WHEN {_TERMINAL} THEN atm_location END AS atm_location, {_REMARKS} AS remarks"""
_TYPED_COLUMNS = ["path", "sheet", "r", "category", "ack_no", "victim_account", "victim_bank", "beneficiary_account", "raw_beneficiary_bank", "ifsc_code", "beneficiary_bank", "bank_flag", "transaction_date", "transaction_amount", "disputed_amount", "utr_no", "payment_mode", "layer_no", "atm_id", "atm_location", "remarks"]
_EXTRA_FILES = "extra AS (SELECT DISTINCT file FROM sheeted WHERE file % 10 = 0)"
_TRANSFER_MAP = "(0, 'ack_no', 'exact'), (1, 'victim_account', 'exact'), (2, 'victim_bank', 'exact'), (3, 'layer_no', 'exact'), (4, 'beneficiary_account', 'exact'), (5, 'beneficiary_bank', 'exact'), (6, 'ifsc_code', 'exact'), (7, 'transaction_date', 'exact'), (8, 'transaction_amount', 'similar'), (9, 'disputed_amount', 'exact'), (10, 'utr_no', 'exact'), (11, 'remarks', 'exact')"
_CASH_MAP = "(0, 'ack_no', 'exact'), (1, 'victim_account', 'exact'), (2, 'layer_no', 'exact'), (3, 'transaction_amount', 'exact'), (4, 'transaction_date', 'exact'), (5, 'remarks', 'exact')"


@query("ingest_rows", on_ledger(_SHEETED, select=f"SELECT {_TYPED} FROM sheeted WHERE problem IS NULL AND NOT is_old"), source=ledger_rows)
def _(sheets):
    return ingest.parse_workbooks(sheets, ("rows",))["rows"].select(_TYPED_COLUMNS)


@query("ingest_old_transactions", on_ledger(_SHEETED, select=f"SELECT {_TYPED}, sheeted.utr_no AS parent_txn, victim_account AS parent_account FROM sheeted WHERE is_old"), source=ledger_rows)
def _(sheets):
    return ingest.parse_workbooks(sheets, ("old_transactions",))["old_transactions"].select(*_TYPED_COLUMNS, "parent_txn", "parent_account")


@query("ingest_sheets", on_ledger(_SHEETED, select="SELECT path, sheet_no, sheet, category, category <> 'OTHER' AS known, count(*) + count(DISTINCT CASE WHEN o % 7 = 0 THEN o END) AS data_rows, problem FROM sheeted GROUP BY ALL"), source=ledger_rows)
def _(sheets):
    return ingest.parse_workbooks(sheets, ("sheets",))["sheets"].select("path", "sheet_no", "sheet", "category", "known", "data_rows", "problem")


@query("ingest_mapping", on_ledger(_SHEETED, "heads AS (SELECT DISTINCT path, sheet, sheet_no, k FROM sheeted)", f"layouts AS (SELECT 0 AS layout, * FROM (VALUES {_TRANSFER_MAP}) v(c, field, how) UNION ALL SELECT 1, * FROM (VALUES {_CASH_MAP}) w(c, field, how))", select="SELECT path, sheet, c, field, how FROM heads JOIN layouts ON layout = CASE WHEN sheet_no = 0 THEN 0 ELSE 1 END WHERE NOT (k = 0 AND sheet_no = 0 AND c = 9)"), source=ledger_rows)
def _(sheets):
    return ingest.parse_workbooks(sheets, ("mapping",))["mapping"].select("path", "sheet", "c", "field", "how")


@query("ingest_errors", on_ledger(_SHEETED, _EXTRA_FILES, select="""SELECT DISTINCT path, sheet, problem FROM sheeted WHERE problem IN ('REQUIRED_COLUMN_MISSING', 'UNKNOWN_CHANNEL') UNION ALL SELECT 'broken-' || file || '.xlsx', NULL, 'not an .xlsx workbook' FROM extra
 UNION ALL SELECT 'notes-' || file || '.xlsx', NULL, 'NOT_AN_EXPORT' FROM extra UNION ALL SELECT 'case-' || file || '.docx', NULL, 'FILE_TYPE' FROM extra"""), source=ledger_rows)
def _(sheets):
    return ingest.parse_workbooks(sheets, ("errors",))["errors"]


@query("ingest_merged_cells", on_ledger(_SHEETED, select="SELECT path, sheet, r, ack_no AS value FROM sheeted"), source=ledger_rows)
def _(sheets):
    return ingest.fill_merged(sheets).where("c = 0 AND r > 1 AND value LIKE 'ACK%'").select("path", "sheet", "r", "value")


@query("ingest_header_rows", on_ledger(_SHEETED, select="SELECT DISTINCT path, sheet_no, sheet, 1 AS header_r FROM sheeted"), source=ledger_rows)
def _(sheets):
    return ingest.header_rows(sheets)


@query("row_problems", on_ledger(select="SELECT id, CASE WHEN id % 13 = 0 THEN 'no account' ELSE 'layer out of bounds' END AS problem FROM flagged WHERE id % 13 = 0 OR id % 17 = 0 ORDER BY id LIMIT 100"))
def _(l):
    gone = F.col("id") % 13 == 0
    hurt = l.withColumns({c: F.when(~gone, F.col(c)) for c in ("victim_account", "beneficiary_account")})
    return ingest.row_problems(hurt.withColumn("layer_no", F.when(F.col("id") % 17 == 0, 25).otherwise(F.col("layer_no"))))


# -- display forms, order and nested values ------------------------------------
@query("dates_shown", on_ledger(select="SELECT id, strftime(transaction_date, '%d %b %Y') AS shown FROM flagged"))
def _(l):
    return _flagged(l).select("id", text.display_date(F.col("transaction_date")).alias("shown"))


@query("identifiers_cleaned", on_ledger(select="SELECT id, (remarks || ' b')[1:20] AS cleaned FROM flagged"))
def _(l):
    return _flagged(l).select("id", text.safe_identifier(F.concat(F.lit(" <"), "remarks", F.lit("\x07> &b'\"`")), 20).alias("cleaned"))


@query("nulls_last", on_ledger(select=f"SELECT id, {S('transaction_date')} FROM flagged ORDER BY flagged.transaction_date NULLS LAST, id DESC LIMIT 50"))
def _(l):
    return browse.page(_flagged(l), by="transaction_date", descending=False, nulls_last=True).select("id", "transaction_date")


@query("details_decoded", on_ledger(select=f"SELECT id, ack_no AS subject, {D('transaction_amount', 'amount')}, layer_no FROM flagged"))
def _(l):
    details = F.to_json(F.struct(F.col("ack_no").alias("subject"), F.col("transaction_amount").alias("amount"), "layer_no"))
    read = F.from_json(details, "subject string, amount decimal(18,2), layer_no int")
    return _flagged(l).select("id", read.alias("x")).select("id", "x.*")


@query("demo_trail", """SELECT i + 1 AS id, 'DEMO-1' AS ack_no, layer AS layer_no, CASE WHEN layer = 4 OR layer = 3 AND i % 3 = 0 THEN CASE WHEN i % 4 = 3 THEN 'POS' ELSE 'ATM' END ELSE ['IMPS', 'UPI', 'NEFT'][i % 3 + 1] END AS payment_mode,
 CAST((5 - layer) * 10000 + i * 500 AS DOUBLE) AS transaction_amount FROM (SELECT CAST(range AS BIGINT) AS i, CASE WHEN range < 5 THEN 0 WHEN range < 15 THEN 1 WHEN range < 27 THEN 2 WHEN range < 40 THEN 3 ELSE 4 END AS layer FROM range(50))""", source=lambda spark, sf_dir: demo_trail(spark))
def _(l):
    return l.select("id", "ack_no", "layer_no", "payment_mode", "transaction_amount")
