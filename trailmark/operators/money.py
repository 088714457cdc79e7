"""Money: cash-outs and their cap, liens, recovery, reconciliation, victims, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.core import hops, one_row, total
from trailmark.schema import MONEY


def percent(part, base):
    """``part`` of ``base`` in percent, to one place; 0 if there is no base."""
    return F.when(base > 0, F.round(part.cast("decimal(20,4)") * 100 / base, 1)).otherwise(F.lit(0)).cast("double")


def capped_cashouts(accounts: DataFrame) -> DataFrame:
    """(account_no, cashed, capped, exceeded) of accounts that cashed out: at most what they received in dispute.

    An account without any inflow has no cap.
    """
    cap = F.when(F.col("hops_in") > 0, F.least("total_cashed_out", "disputed_received")).otherwise(F.col("total_cashed_out"))
    some = accounts.where("total_cashed_out > 0").withColumn("capped", cap.cast(MONEY))
    return some.select("account_no", F.col("total_cashed_out").alias("cashed"), "capped", (F.col("total_cashed_out") - F.col("capped") > F.lit("0.005").cast("decimal(18,3)")).alias("exceeded"))


def liens(accounts: DataFrame) -> DataFrame:
    some = accounts.where("lien_eligible_amount > 0")
    return some.select("account_no", "bank_name", "ifsc_code", "layer_no", "total_received", "disputed_received", "onward_forwarded", "total_cashed_out", "total_on_hold", "gross_balance", "lien_eligible_amount", (F.col("gross_balance") - F.col("lien_eligible_amount")).cast(MONEY).alias("cap_excess"))


def excluded_liens(accounts: DataFrame) -> DataFrame:
    """Accounts with a balance of which nothing was in dispute."""
    return accounts.where("gross_balance > 0 AND lien_eligible_amount = 0").select("account_no", "bank_name", "gross_balance", F.lit("no disputed inflow").alias("excluded_reason"))


def first_layer(rows: DataFrame) -> DataFrame:
    """Hops of the least layer that has any."""
    only = hops(rows)
    return only.where(F.col("layer_no") == only.agg(F.min("layer_no")).scalar())


def victims(rows: DataFrame) -> DataFrame:
    return first_layer(rows).groupBy(F.col("victim_key").alias("account_no")).agg(F.count("*").alias("txn_count"), total(F.col("transaction_amount")).alias("amount_sent"))


def recovery(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row: loss, and which parts of it were cashed out, are held and may be recovered."""
    loss = first_layer(rows).agg(total(F.col("disputed_amount")).alias("base_amount"))
    cashed = capped_cashouts(accounts).agg(total(F.col("capped")).alias("cashed_out"))
    held = rows.where("row_kind = 'HOLD'").agg(total(F.col("transaction_amount")).alias("on_hold"))
    one = one_row(loss, cashed, held)
    one = one.withColumn("refunded", F.lit(0).cast(MONEY))
    one = one.withColumn("recoverable", F.greatest(F.col("base_amount") - F.col("cashed_out") - F.col("on_hold") - F.col("refunded"), F.lit(0)).cast(MONEY))
    return one.select("*", *[percent(F.col(c), F.col("base_amount")).alias(f"{c}_pct") for c in ("cashed_out", "on_hold", "refunded", "recoverable")])


def reconciliation(flagged: DataFrame) -> DataFrame:
    """One row over all enriched legs with ``is_duplicate``: where the disputed money and the legs are."""
    disputed, fresh = F.col("disputed_amount"), ~F.col("is_duplicate")
    kind = lambda k: F.col("row_kind") == k
    dated = F.col("transaction_date").isNotNull()
    return flagged.agg(
        total(disputed, kind("HOP")).alias("raw_hop"),
        total(disputed, kind("HOP") & ~fresh).alias("dedup_hop_adjustment"),
        *[total(disputed, kind(k) & fresh).alias(k.lower()) for k in ("HOP", "EXIT", "HOLD", "OTHER")],
        total(disputed, fresh).alias("total"),
        F.count(F.when(fresh & dated, 1)).alias("dated"),
        F.count(F.when(fresh & ~dated, 1)).alias("undated"),
        total(F.col("transaction_amount"), fresh & ~dated).alias("undated_amount"),
        F.count(F.when(fresh, 1)).alias("unique_legs"),
        F.count(F.when(~fresh, 1)).alias("duplicates"),
        F.count("*").alias("raw_legs"),
    )


#: What a summary reads of accounts.
SUMMARIZED = ("account_no", "hops_in", "disputed_received", "total_cashed_out", "lien_eligible_amount")


def summary(flagged: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row with the headline figures of a ledger."""
    fresh = F.col("is_duplicate") == F.lit(False)
    hop = fresh & (F.col("row_kind") == "HOP")
    base = flagged.agg(
        F.count("*").alias("total_transactions"),
        F.count(F.when(hop, 1)).alias("unique_transactions"),
        F.count(F.when(F.col("is_duplicate"), 1)).alias("duplicate_count"),
        F.countDistinct(F.when(hop, F.col("layer_no"))).alias("total_layers"),
        total(F.col("disputed_amount"), fresh).alias("total_disputed_amount"),
        F.min(F.when(fresh, F.col("day"))).alias("fraud_start_date"),
    )
    of = accounts.agg(F.count(F.when(F.col("hops_in") > 0, 1)).alias("total_accounts"), total(F.col("lien_eligible_amount")).alias("lien_table_total"))
    money = recovery(flagged.where("NOT is_duplicate"), accounts).select(F.col("base_amount").alias("victim_loss_amount"), "cashed_out", "on_hold", "refunded", F.col("recoverable").alias("recoverable_residual"))
    return one_row(base, of, money)


def cashout_view(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row: capped and uncapped cash-outs, same-day ones, and the fastest after a victim's debit."""
    same = same_day_exits(rows)
    exits = rows.where("row_kind = 'EXIT'").agg(F.count("*").alias("total_cashout_transactions"), total(F.col("transaction_amount")).alias("total_cashout_amount_uncapped"), F.min("transaction_date").alias("_first"))
    capped = capped_cashouts(accounts).agg(total(F.col("capped")).alias("total_cashout_amount"))
    debit = first_layer(rows).agg(F.min("transaction_date")).scalar()
    after = rows.where("row_kind = 'EXIT'").where(F.col("transaction_date") >= debit).agg(F.min("transaction_date").alias("_cash"))
    one = one_row(exits, capped, same.agg(F.count("*").alias("same_day_cashouts")), after, first_layer(rows).agg(F.min("transaction_date").alias("_debit")))
    one = one.withColumn("_s", F.timestamp_diff("SECOND", F.col("_debit"), F.col("_cash")))
    return one.select("total_cashout_amount", "total_cashout_amount_uncapped", F.lit("CAP_AT_RECEIVED").alias("cashout_policy"), "total_cashout_transactions", "same_day_cashouts", F.round(F.col("_s") / 3600, 2).alias("fastest_cashout_hours"))


def same_day_exits(rows: DataFrame) -> DataFrame:
    """ATM exits on the day of the account's first receipt, by the stored calendar day."""
    receipts = hops(rows).where("day IS NOT NULL").groupBy(F.col("benef_key").alias("_account")).agg(F.min("day").alias("_first_day"))
    exits = rows.where("row_kind = 'EXIT' AND cashout_mode = 'ATM'")
    return exits.join(receipts, (F.col("cash_account") == F.col("_account")) & (F.col("day") == F.col("_first_day")), "left_semi")


def cashouts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.where("row_kind = 'EXIT'").groupBy(*keys).agg(total(F.col("transaction_amount")).alias("amount"), F.count("*").alias("count"))


def cashout_reconciliation(flagged: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row: gross cash-outs shown, less repeated legs, less what is above the cap, is what is confirmed."""
    exit_ = F.col("row_kind") == "EXIT"
    gross = flagged.agg(total(F.col("transaction_amount"), exit_).alias("gross_shown"), total(F.col("transaction_amount"), exit_ & F.col("is_duplicate")).alias("dup_amount_shown"))
    cap = capped_cashouts(accounts).agg(total(F.col("cashed") - F.col("capped")).alias("cap_excess"), total(F.col("capped")).alias("confirmed"))
    return one_row(gross, cap)
