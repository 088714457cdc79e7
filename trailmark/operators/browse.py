"""Browsing a ledger: filters, search, sort, pages, facets and drill-downs."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import escaped_like, or_empty
from trailmark.operators.core import hops, total

SORTS = ("id", "transaction_date", "transaction_amount", "disputed_amount", "layer_no", "victim_account", "beneficiary_account", "beneficiary_bank", "payment_mode", "utr_no", "city", "state")
SEARCHED = ("utr_no", "victim_account", "beneficiary_account", "beneficiary_name", "remarks")
PAGE_MOST = 500


def filtered(
    rows: DataFrame,
    layers: list[int] | None = None,
    banks: list[str] | None = None,
    mode: str | None = None,
    beneficiary: str | None = None,
    city: str | None = None,
    state: str | None = None,
    date_from: datetime.datetime | None = None,
    date_to: datetime.datetime | None = None,
    amount_from: Decimal | None = None,
    amount_to: Decimal | None = None,
    text: str | None = None,
) -> DataFrame:
    """Rows that meet all conditions; ``text`` is sought in five columns, wildcards taken literally.

    Times compare as times, so a day as ``date_to`` ends at its midnight.
    """
    conditions: list[Column] = []
    if layers:
        conditions.append(F.col("layer_no").isin(layers))
    if banks:
        conditions.append(F.col("beneficiary_bank").isin(banks))
    if mode is not None:
        conditions.append(F.upper("payment_mode") == mode.upper())
    for name, value in (("beneficiary_account", beneficiary), ("city", city), ("state", state)):
        if value is not None:
            conditions.append(F.col(name) == value)
    for name, least, most in (("transaction_date", date_from, date_to), ("transaction_amount", amount_from, amount_to)):
        kind = "timestamp_ntz" if name == "transaction_date" else "decimal(18,2)"
        if least is not None:
            conditions.append(F.col(name) >= F.lit(str(least)).cast(kind))
        if most is not None:
            conditions.append(F.col(name) <= F.lit(str(most)).cast(kind))
    if text:
        found = F.lit(False)
        for name in SEARCHED:
            found = found | F.coalesce(F.col(name).ilike(escaped_like(text)), F.lit(False))
        conditions.append(found)
    for c in conditions:
        rows = rows.where(c)
    return rows


def order_of(by: str = "transaction_date", descending: bool = True, nulls_last: bool = False) -> list[Column]:
    """One of SORTS, ties by id from the newest; anything else sorts by date."""
    c = F.col(by if by in SORTS else "transaction_date")
    if nulls_last:
        first = c.desc_nulls_last() if descending else c.asc_nulls_last()
    else:
        first = c.desc() if descending else c.asc()
    return [first, F.desc("id")]


def ordered(rows: DataFrame, by: str = "transaction_date", descending: bool = True, nulls_last: bool = False) -> DataFrame:
    """Sorted by :func:`order_of`."""
    return rows.orderBy(*order_of(by, descending, nulls_last))


def page(rows: DataFrame, number: int = 1, size: int = 50, **sort) -> DataFrame:
    size = max(1, min(size, PAGE_MOST))
    return ordered(rows, **sort).offset((max(1, number) - 1) * size).limit(size)


def page_counts(rows: DataFrame, size: int = 50) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def bank_facet(rows: DataFrame) -> DataFrame:
    return rows.where(or_empty(F.col("beneficiary_bank")) != "").groupBy("beneficiary_bank").agg(F.count("*").alias("count"))


def layer_facet(rows: DataFrame) -> DataFrame:
    return rows.groupBy("layer_no").agg(F.count("*").alias("count"))


def account_legs(rows: DataFrame, account: str) -> DataFrame:
    """Legs of an account in both directions, repeated ones too; a leg to itself comes in."""
    into = F.col("benef_key") == account
    some = rows.where(into | (F.col("victim_key") == account))
    return some.select("id", F.when(into, "in").otherwise("out").alias("direction"), F.when(into, F.col("victim_key")).otherwise(F.col("benef_key")).alias("counterparty"), "transaction_date", "transaction_amount", "disputed_amount", "payment_mode", "layer_no", "is_duplicate")


def terminal_legs(rows: DataFrame, terminal: str) -> DataFrame:
    """Exits at a terminal; ``UNKNOWN_ATM`` is those without one."""
    own = or_empty(F.col("atm_id"))
    return rows.where("row_kind = 'EXIT'").where(own == ("" if terminal == "UNKNOWN_ATM" else terminal))


def edge_legs(rows: DataFrame, source: str, destination: str) -> DataFrame:
    return hops(rows).where((F.col("victim_key") == source) & (F.col("benef_key") == destination))


def bank_legs(rows: DataFrame, bank: str) -> DataFrame:
    return rows.where(F.col("beneficiary_bank") == bank)


def day_legs(rows: DataFrame, day: str) -> DataFrame:
    return rows.where(F.col("day") == F.lit(day).cast("date"))


def layer_accounts(scored: DataFrame, layer: int) -> DataFrame:
    return scored.where(F.col("layer_no") == layer)


def risk_list(scored: DataFrame, risk: str | None = None, layers: list[int] | None = None, bank: str | None = None, text: str | None = None, received_from: Decimal | None = None, received_to: Decimal | None = None) -> DataFrame:
    """Scored accounts that meet all conditions; ``text`` is sought in account and bank."""
    for c in (
        F.col("risk_label") == risk if risk else None,
        F.col("layer_no").isin(layers) if layers else None,
        F.col("bank_name") == bank if bank else None,
        F.col("account_no").ilike(escaped_like(text)) | F.coalesce(F.col("bank_name").ilike(escaped_like(text)), F.lit(False)) if text else None,
        F.col("total_received") >= F.lit(str(received_from)).cast("decimal(18,2)") if received_from is not None else None,
        F.col("total_received") <= F.lit(str(received_to)).cast("decimal(18,2)") if received_to is not None else None,
    ):
        if c is not None:
            scored = scored.where(c)
    return scored


def leg_fields(rows: DataFrame, leg: int) -> DataFrame:
    """(field, value) of one leg, fields without a value left out."""
    some = rows.where(F.col("id") == leg)
    names = [c for c in some.columns if c != "id"]
    text = some.select("id", *[F.col(c).cast("string").alias(c) for c in names])
    return text.unpivot("id", names, "field", "value").where(or_empty(F.col("value")) != "").select("field", "value")


def merchants(rows: DataFrame) -> DataFrame:
    """POS exits by merchant and terminal."""
    name = F.when(or_empty(F.col("atm_location")) != "", F.trim("atm_location")).when(or_empty(F.col("beneficiary_name")) != "", F.trim("beneficiary_name")).otherwise("UNKNOWN_MERCHANT")
    terminal = F.when(or_empty(F.col("atm_id")) != "", F.trim("atm_id")).otherwise("—")
    return rows.where(F.upper(or_empty(F.col("payment_mode"))) == "POS").groupBy(name.alias("name"), terminal.alias("terminal_id")).agg(total(F.col("transaction_amount")).alias("amount"), F.count("*").alias("txn_count"))


def atm_terminals(rows: DataFrame) -> DataFrame:
    """Terminals of exits without those that only POS legs name."""
    mode = F.upper(or_empty(F.col("payment_mode")))
    some = rows.where(or_empty(F.col("atm_id")) != "").where("row_kind = 'EXIT'")
    shops = some.groupBy("atm_id").agg(F.count(F.when(mode == "POS", 1)).alias("p"), F.count(F.when(mode == "ATM", 1)).alias("a")).where("p > 0 AND a = 0").select("atm_id")
    return some.groupBy("atm_id").agg(total(F.col("transaction_amount")).alias("amount"), F.count("*").alias("count")).join(shops, "atm_id", "left_anti")


def accounts_per_terminal(rows: DataFrame) -> DataFrame:
    some = rows.where(or_empty(F.col("atm_id")) != "").where("cash_account <> ''")
    return some.groupBy("atm_id").agg(F.countDistinct("cash_account").alias("accounts"))


def bank_rankings(lien_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Banks by what liens could take, with the number of their legs."""
    sums = lien_rows.where(or_empty(F.col("bank_name")) != "").groupBy("bank_name").agg(F.count("*").alias("accounts"), total(F.col("lien_eligible_amount")).alias("lien_total"))
    return sums.join(bank_facet(rows).select(F.col("beneficiary_bank").alias("bank_name"), F.col("count").alias("legs")), "bank_name", "left").select("bank_name", "accounts", "lien_total", F.coalesce("legs", F.lit(0)).alias("legs"))
