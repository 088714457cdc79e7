"""SQL over the driver's tables: the ledger as common table expressions."""

from __future__ import annotations

from trailmark.functions.banks import BANKS, GENERIC
from trailmark.sources.adapter import CODES, LINE_ORDER, NAMES, REPEAT_EVERY, UNDATED_EVERY, UNDISPUTED_EVERY


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(map(_text, values))}])[CAST({index} AS INT) + 1]"


def _core(c: str) -> str:
    low = f"lower(trim(coalesce({c}, '')))"
    bare = rf"regexp_replace({low}, '\(.*?\)', ' ', 'g')"
    tidy = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    core = tidy(f"regexp_replace({bare}, {_text(GENERIC)}, ' ', 'g')")
    return f"CASE WHEN {low} IN ('others', 'other', 'na') THEN '' WHEN {core} <> '' THEN {core} ELSE {tidy(bare)} END"


def _key(c: str) -> str:
    t = f"trim(coalesce({c}, ''))"
    return f"CASE WHEN regexp_matches({t}, '^[0-9]+$') THEN regexp_replace({t}, '^0+([0-9])', '\\1') ELSE {t} END"


_ENRICH = f"""
keyed AS (SELECT *, {_key("victim_account")} AS victim_key, {_key("beneficiary_account")} AS benef_key, upper(trim(coalesce(payment_mode, ''))) AS m, trim(coalesce(atm_id, '')) <> '' AS has_terminal FROM NAMED),
kinds AS (
  SELECT *, CASE WHEN m = 'HOLD' THEN 'HOLD' WHEN m IN ('ATM', 'POS', 'AEPS') OR has_terminal THEN 'EXIT'
                 WHEN victim_key <> '' AND benef_key <> '' AND victim_key <> benef_key THEN 'HOP' ELSE 'OTHER' END AS row_kind FROM keyed),
enriched AS (
  SELECT *, CASE WHEN row_kind = 'EXIT' THEN CASE WHEN has_terminal THEN 'ATM' ELSE m END END AS cashout_mode,
         CASE WHEN benef_key <> '' THEN benef_key ELSE victim_key END AS cash_account, CAST(transaction_date AS DATE) AS day FROM kinds),
flagged AS (
  SELECT *, id <> min(id) OVER (PARTITION BY victim_key, benef_key, transaction_date, transaction_amount, disputed_amount, coalesce(utr_no, '')) AS is_duplicate FROM enriched),
legs AS (SELECT * FROM flagged WHERE NOT is_duplicate)"""

LEDGER = f"""
bank_map(prefix, mapped) AS (VALUES {", ".join(f"({_text(p)}, {_text(b)})" for p, b in BANKS.items())}),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem),
lines AS (
  SELECT *, l_orderkey * 1000 + rn AS id FROM placed
  UNION ALL SELECT *, l_orderkey * 1000 + rn + 500 FROM placed WHERE (l_orderkey + rn) % {REPEAT_EVERY} = 0),
moded AS (
  SELECT l.*, o_orderkey, o_custkey, o_orderdate, n_name, r_name,
         CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'IMPS' WHEN 'AO' THEN 'UPI' WHEN 'NF' THEN 'NEFT' WHEN 'RF' THEN 'AEPS' WHEN 'RO' THEN 'HOLD'
              ELSE CASE WHEN l_quantity % 2 = 0 THEN 'ATM' ELSE 'POS' END END AS mode
  FROM lines l JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT id, o_orderkey % 7 + 1 AS report_id, 'ACK' || (o_orderkey % 50) AS ack_no, o_orderdate AS complaint_date,
         CAST(o_custkey AS VARCHAR) AS victim_account, {_pick(NAMES, f"o_custkey % {len(NAMES)}")} AS victim_bank,
         CASE WHEN mode IN ('ATM', 'POS', 'AEPS', 'HOLD') THEN CAST(o_custkey AS VARCHAR) WHEN l_suppkey % 20 = 0 THEN '00' || l_partkey
              WHEN l_suppkey % 10 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE 'P' || l_partkey END AS beneficiary_account,
         {_pick(NAMES, f"l_partkey % {len(NAMES)}")} AS raw_beneficiary_bank, 'Name ' || l_partkey AS beneficiary_name,
         {_pick(CODES, f"l_suppkey % {len(CODES)}")} AS ifsc_code,
         CASE WHEN (l_partkey + l_suppkey) % {UNDATED_EVERY} <> 0 THEN l_shipdate + ((l_suppkey % 24) * 60 + l_partkey % 60) * INTERVAL 1 MINUTE END AS transaction_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS transaction_amount,
         CASE WHEN l_partkey % {UNDISPUTED_EVERY} = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)) * 5) AS DECIMAL(18,2)) END AS disputed_amount,
         'U' || l_orderkey || '-' || l_linenumber AS utr_no, mode AS payment_mode, CAST(l_linenumber AS INT) AS layer_no,
         CASE WHEN mode IN ('ATM', 'POS') THEN 'T' || (l_suppkey % 40) END AS atm_id, CASE WHEN mode IN ('ATM', 'POS') THEN 'Place ' || (l_suppkey % 40) END AS atm_location,
         n_name AS city, r_name AS state, mode || ' ref ' || l_orderkey AS remarks
  FROM moded),
coded AS (SELECT *, CASE WHEN regexp_matches(upper(trim(coalesce(ifsc_code, ''))), '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') THEN upper(trim(ifsc_code)) END AS code FROM raw),
named AS (
  SELECT coded.*, CASE WHEN mapped IS NOT NULL THEN mapped WHEN trim(raw_beneficiary_bank) <> '' THEN trim(raw_beneficiary_bank)
              WHEN code IS NULL OR code LIKE 'PPIW%' THEN 'Unknown' ELSE 'Unknown (IFSC ' || code[1:4] || ')' END AS beneficiary_bank,
         CASE WHEN mapped IS NOT NULL THEN 'IFSC' ELSE 'TEXT' END AS bank_source,
         CASE WHEN code IS NULL AND trim(coalesce(ifsc_code, '')) <> '' THEN 'INVALID_IFSC' WHEN code IS NULL OR code LIKE 'PPIW%' THEN 'NO_IFSC'
              WHEN mapped IS NULL THEN 'UNKNOWN_IFSC_PREFIX'
              WHEN NOT ({_core("mapped")} = '' OR {_core("raw_beneficiary_bank")} = '' OR contains({_core("mapped")}, {_core("raw_beneficiary_bank")}) OR contains({_core("raw_beneficiary_bank")}, {_core("mapped")})) THEN 'IFSC_TEXT_MISMATCH' END AS bank_flag
  FROM coded LEFT JOIN bank_map ON code[1:4] = prefix),
{_ENRICH.replace("NAMED", "named")}"""

EVENTS = f"""
emoded AS (SELECT *, CASE WHEN event_id % 7 IN (0, 1, 2) THEN 'ATM' WHEN event_id % 7 IN (3, 4) THEN 'POS' WHEN event_id % 7 = 5 THEN 'AEPS' ELSE 'UPI' END AS mode FROM events),
enamed AS (
  SELECT event_id AS id, 'ACK' || (user_id % 20) AS ack_no, CASE WHEN mode = 'UPI' THEN 'V' || (event_id % 50) ELSE 'E' || user_id END AS victim_account, 'E' || user_id AS beneficiary_account,
         ts AS transaction_date, CAST(abs(coalesce(value, 0)) AS DECIMAL(18,2)) AS transaction_amount, CAST(abs(coalesce(value, 0)) AS DECIMAL(18,2)) AS disputed_amount,
         'E' || event_id AS utr_no, mode AS payment_mode, 1 AS layer_no, CASE WHEN mode = 'POS' THEN 'S' || (event_id % 2) WHEN mode <> 'UPI' THEN 'T' || (event_id % 30) END AS atm_id
  FROM emoded),
{_ENRICH.replace("NAMED", "enamed")},
exits AS (SELECT *, CASE WHEN m IN ('POS', 'AEPS') THEN m ELSE 'ATM' END AS channel FROM legs WHERE row_kind = 'EXIT')"""

ROLLUP = """
touches AS (
  SELECT benef_key AS account_no, 'in' AS role, * FROM legs WHERE row_kind = 'HOP'
  UNION ALL SELECT victim_key, 'out', * FROM legs WHERE row_kind = 'HOP'
  UNION ALL SELECT cash_account, 'cash', * FROM legs WHERE row_kind = 'EXIT'
  UNION ALL SELECT cash_account, 'hold', * FROM legs WHERE row_kind = 'HOLD'),
sums AS (
  SELECT account_no, arg_min(beneficiary_bank, id) FILTER (WHERE role <> 'out') AS bank_name, arg_min(ifsc_code, id) FILTER (WHERE role <> 'out' AND ifsc_code IS NOT NULL) AS ifsc_code,
         min(layer_no) FILTER (WHERE role = 'in') AS layer_no,
         coalesce(sum(transaction_amount) FILTER (WHERE role = 'in'), 0) AS total_received, coalesce(sum(disputed_amount) FILTER (WHERE role = 'in'), 0) AS disputed_received,
         coalesce(sum(transaction_amount) FILTER (WHERE role = 'out'), 0) AS onward_forwarded, coalesce(sum(disputed_amount) FILTER (WHERE role = 'out'), 0) AS disputed_forwarded,
         coalesce(sum(transaction_amount) FILTER (WHERE role = 'cash'), 0) AS total_cashed_out, coalesce(sum(transaction_amount) FILTER (WHERE role = 'hold'), 0) AS total_on_hold,
         count(DISTINCT victim_key) FILTER (WHERE role = 'in') AS distinct_senders, count(*) FILTER (WHERE role = 'in') AS hops_in, count(*) AS txn_count,
         min(transaction_date) FILTER (WHERE role = 'in') AS first_received
  FROM touches WHERE account_no <> '' GROUP BY account_no),
accounts AS (
  SELECT *, onward_forwarded + total_cashed_out AS total_forwarded, greatest(total_received - onward_forwarded - total_on_hold - total_cashed_out, 0) AS gross_balance,
         greatest(least(greatest(total_received - onward_forwarded - total_on_hold - total_cashed_out, 0), disputed_received), 0) AS lien_eligible_amount
  FROM sums),
capped AS (
  SELECT account_no, total_cashed_out AS cashed, CASE WHEN hops_in > 0 THEN least(total_cashed_out, disputed_received) ELSE total_cashed_out END AS capped FROM accounts WHERE total_cashed_out > 0),
first_layer AS (SELECT * FROM legs WHERE row_kind = 'HOP' AND layer_no = (SELECT min(layer_no) FROM legs WHERE row_kind = 'HOP')),
money AS (
  SELECT (SELECT coalesce(sum(disputed_amount), 0) FROM first_layer) AS base_amount, (SELECT coalesce(sum(capped), 0) FROM capped) AS cashed_out,
         (SELECT coalesce(sum(transaction_amount), 0) FROM legs WHERE row_kind = 'HOLD') AS on_hold),
liens AS (SELECT * FROM accounts WHERE lien_eligible_amount > 0)"""

EDGES = """
edges AS (
  SELECT victim_key AS source, benef_key AS destination, sum(transaction_amount) AS amount, sum(disputed_amount) AS disputed, count(*) AS txns,
         list_sort(list(DISTINCT layer_no)) AS layers, list_sort(list(DISTINCT CASE WHEN trim(beneficiary_bank) <> '' THEN beneficiary_bank END) FILTER (WHERE trim(beneficiary_bank) <> '')) AS banks
  FROM legs WHERE row_kind = 'HOP' GROUP BY ALL),
degrees AS (
  SELECT account_no, count(*) FILTER (WHERE way = 'in') AS in_degree, count(*) FILTER (WHERE way = 'out') AS out_degree,
         coalesce(sum(amount) FILTER (WHERE way = 'in'), 0) AS total_in, coalesce(sum(amount) FILTER (WHERE way = 'out'), 0) AS total_out,
         array_to_string(list_sort(list_distinct(flatten(list(banks) FILTER (WHERE way = 'in')))), '; ') AS bank
  FROM (SELECT destination AS account_no, 'in' AS way, * FROM edges UNION ALL SELECT source, 'out', * FROM edges) GROUP BY account_no)"""


def on_ledger(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((LEDGER, *parts)) + "\n" + select


def on_events(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join((EVENTS, *parts)) + "\n" + select
