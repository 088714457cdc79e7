"""Data quality of bank attribution, instruments, and letters to banks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.banks import WALLETS, instrument_kind
from trailmark.functions.text import account_key, or_empty
from trailmark.operators.core import one_row, total
from trailmark.operators.money import percent
from trailmark.schema import MONEY

FLAGS = ("IFSC_TEXT_MISMATCH", "UNKNOWN_IFSC_PREFIX", "INVALID_IFSC", "NO_IFSC")


def flagged_accounts(rows: DataFrame) -> DataFrame:
    """One row for each account whose bank is in doubt: the flag of its first leg that tells most.

    A leg with a valid code wins over one without; severity is informational
    for corrected names, wallets, and accounts that a code confirms elsewhere.
    """
    own = rows.where("benef_key <> ''")
    rank = F.when(F.col("bank_source") == "IFSC", 0).when(F.col("bank_flag") == "UNKNOWN_IFSC_PREFIX", 1).otherwise(2)
    best = own.groupBy(F.col("benef_key").alias("account_no")).agg(
        F.min_by(F.struct("beneficiary_bank", "raw_beneficiary_bank", "ifsc_code", "bank_source", "bank_flag"), F.struct(rank.alias("r"), F.col("bank_flag").isNull().alias("n"), "id")).alias("b")
    )
    found = best.select("account_no", F.col("b.beneficiary_bank").alias("bank"), F.col("b.raw_beneficiary_bank").alias("raw_bank"), "b.ifsc_code", "b.bank_source", "b.bank_flag").where("bank_flag IS NOT NULL")
    confirmed = rows.where("bank_source = 'IFSC'").select(F.col("beneficiary_bank").alias("bank")).distinct().withColumn("_seen", F.lit(True))
    found = found.join(confirmed, "bank", "left")
    harmless = (F.col("bank_flag") == "IFSC_TEXT_MISMATCH") | ((F.col("bank_flag") == "NO_IFSC") & (or_empty(F.col("bank")).rlike(WALLETS) | F.col("_seen").isNotNull()))
    order = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("bank_flag")).cast("int")
    message = (
        F.when(F.col("bank_flag") == "IFSC_TEXT_MISMATCH", F.concat(F.lit("Code says "), "bank", F.lit(", text said "), "raw_bank"))
        .when(F.col("bank_flag") == "UNKNOWN_IFSC_PREFIX", F.concat(F.lit("No bank is known for code "), "ifsc_code"))
        .when(F.col("bank_flag") == "INVALID_IFSC", F.concat(F.lit("Not a branch code: "), "ifsc_code"))
        .otherwise(F.concat(F.lit("No branch code; text says "), "bank"))
    )
    return found.select("account_no", "bank", "raw_bank", "ifsc_code", "bank_source", "bank_flag", message.alias("message"), F.when(harmless, "informational").otherwise("actionable").alias("severity"), order.alias("place"))


def quality_summary(rows: DataFrame, flagged: DataFrame, lien_rows: DataFrame) -> DataFrame:
    """One row: flagged accounts by severity, those a lien would hit, and the status red, amber or green."""
    actionable = F.col("severity") == "actionable"
    counts = flagged.agg(F.count("*").alias("flagged_accounts"), F.count(F.when(actionable, 1)).alias("actionable_accounts"), F.count(F.when(F.col("bank_flag") == FLAGS[0], 1)).alias("auto_corrected"), F.count(F.when(~actionable & (F.col("bank_flag") == "NO_IFSC"), 1)).alias("expected_no_ifsc"))
    targets = flagged.where(actionable).join(lien_rows.select("account_no"), "account_no", "left_semi").agg(F.count("*").alias("freeze_target_accounts"))
    one = one_row(counts, targets, rows.where("benef_key <> ''").agg(F.countDistinct("benef_key").alias("total_accounts")))
    status = F.when(F.col("freeze_target_accounts") > 0, "red").when(F.col("actionable_accounts") > 0, "amber").otherwise("green")
    return one.select("*", percent(F.col("flagged_accounts"), F.col("total_accounts")).alias("pct_affected"), status.alias("status"))


def with_instrument(lien_rows: DataFrame) -> DataFrame:
    return lien_rows.withColumn("instrument", instrument_kind(F.col("account_no"), F.col("ifsc_code"), F.col("bank_name")))


def letter_accounts(lien_rows: DataFrame) -> DataFrame:
    """(bank_key, bank_name, account_no, lien_eligible_amount): the accounts that each bank's letter lists, bank accounts only."""
    some = with_instrument(lien_rows).where("instrument = 'bank'")
    return some.select(F.lower(F.trim(F.coalesce("bank_name", F.lit("Unknown")))).alias("bank_key"), "bank_name", "account_no", "lien_eligible_amount")


def letters(lien_rows: DataFrame) -> DataFrame:
    """(bank_key, bank_name, account_count, total_amount): one letter to each bank; :func:`letter_accounts` has its lines."""
    return letter_accounts(lien_rows).groupBy("bank_key").agg(F.min("bank_name").alias("bank_name"), F.count("*").alias("account_count"), total(F.col("lien_eligible_amount")).alias("total_amount"))


def letters_to_send(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(bank_key, total_amount, changed_accounts, status): a bank's letter is sent again if any of its accounts is another or has another amount.

    Both have the lines of letters (bank_key, account_no, lien_eligible_amount),
    ``stored`` with the ``status`` of the letter.  ``sent`` stays only where all
    lines are the same; letters without fresh lines are withdrawn.
    """
    keys = ["bank_key", "account_no"]
    new = fresh.groupBy(*keys).agg(total(F.col("lien_eligible_amount")).alias("_new"))
    old = stored.groupBy(*keys).agg(total(F.col("lien_eligible_amount")).alias("_old"), F.max("status").alias("_status"))
    lines = new.join(old, keys, "full_outer")
    found = lines.groupBy("bank_key").agg(
        F.sum("_new").alias("_fresh"), total(F.col("_old")).alias("_stored"), F.count(F.when(~F.col("_new").eqNullSafe(F.col("_old")), 1)).alias("changed_accounts"), F.max("_status").alias("_status")
    )
    state = F.when(F.col("_fresh").isNull(), "withdrawn").when((F.col("_status") == "sent") & (F.col("changed_accounts") == 0), "sent").otherwise("draft")
    return found.select("bank_key", F.coalesce("_fresh", "_stored").cast(MONEY).alias("total_amount"), "changed_accounts", state.alias("status"))


def hidden_twins(rows: DataFrame) -> DataFrame:
    """Accounts that are written in more than one way, such as with leading zeros."""
    raw = F.trim("beneficiary_account")
    return rows.where("benef_key <> ''").groupBy(account_key(F.col("beneficiary_account")).alias("account_no")).agg(F.countDistinct(raw).alias("spellings"), F.min(raw).alias("shown")).where("spellings > 1")
