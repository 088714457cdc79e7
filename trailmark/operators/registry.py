"""Accounts across reports: contributions, their aggregate, replacing and withdrawing; reports and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import account_key, or_empty
from trailmark.operators.core import total


def contributions(rows: DataFrame) -> DataFrame:
    """(account_no, report_id, bank_name, amount_passed): one row for each account and report, of hops that it received."""
    some = rows.where("row_kind = 'HOP'")
    bank = F.when(or_empty(F.col("beneficiary_bank")) != "", F.col("beneficiary_bank"))
    return some.groupBy(F.col("benef_key").alias("account_no"), "report_id").agg(F.min_by(bank, F.when(bank.isNotNull(), F.col("id"))).alias("bank_name"), total(F.col("transaction_amount")).alias("amount_passed"))


def aggregate(contributed: DataFrame) -> DataFrame:
    """(account_no, bank_name, first_seen_report_id, appearance_count, total_amount_passed); the earliest known bank counts."""
    return contributed.groupBy("account_no").agg(
        F.min_by("bank_name", F.when(F.col("bank_name").isNotNull(), F.col("report_id"))).alias("bank_name"),
        F.min("report_id").alias("first_seen_report_id"),
        F.count("*").alias("appearance_count"),
        total(F.col("amount_passed")).alias("total_amount_passed"),
    )


def replace_report(contributed: DataFrame, report_id: int, fresh: DataFrame) -> DataFrame:
    """All contributions after ``fresh`` took the place of the report's; doing it again changes nothing."""
    cols = ["account_no", "report_id", "bank_name", "amount_passed"]
    own = fresh.withColumn("account_no", account_key(F.col("account_no"))).where("account_no <> ''")
    one = own.groupBy("account_no").agg(F.min("bank_name").alias("bank_name"), total(F.col("amount_passed")).alias("amount_passed")).withColumn("report_id", F.lit(report_id).cast("long"))
    return withdraw_report(contributed, report_id).select(cols).unionByName(one.select(cols))


def withdraw_report(contributed: DataFrame, report_id: int) -> DataFrame:
    return contributed.where(F.col("report_id") != report_id)


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("account_no").union(after.select("account_no")).distinct()


def orphans(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Registered accounts that no ledger row names any more."""
    return registry.join(rows.select(F.col("benef_key").alias("account_no")), "account_no", "left_anti")


def delete_report(tables: dict[str, DataFrame], report_id: int) -> dict[str, DataFrame]:
    """All tables without the rows of a report; the audit log outlives it."""
    return {name: df if name == "audit_log" else df.where(F.col("report_id") != report_id) for name, df in tables.items()}


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``fresh`` in place of those with equal keys; null values of ``fresh`` keep what was stored."""
    other = [c for c in stored.columns if c not in keys]
    new = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in other])
    return stored.join(new, keys, "full_outer").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in other])


def update_liens(stored: DataFrame, news: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Lien records after status changes: (report_id, account_no, bank_name, ifsc_code, status, remarks, applied_date).

    ``news`` has (report_id, account_no, status, remarks), one row for an
    account; null keeps what is stored.  ``applied_date`` is stamped when the
    status becomes ``applied`` for the first time, and stays.  Accounts without
    a record get one, ``pending`` unless said otherwise, with the bank and code
    of their first leg in ``rows`` that has them.
    """
    keys = ["report_id", "account_no"]
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    fresh = news.select(*keys, F.col("status").alias("_status"), F.col("remarks").alias("_remarks"))
    both = stored.withColumn("_old", F.lit(True)).join(fresh, keys, "full_outer")
    bank = F.when(or_empty(F.col("beneficiary_bank")) != "", F.col("beneficiary_bank"))
    legs_of = rows.select("report_id", F.col("benef_key").alias("account_no"), "id", bank.alias("_b"), "ifsc_code").join(fresh.select(*keys), keys, "left_semi")
    known = legs_of.groupBy(*keys).agg(F.min_by("_b", F.when(F.col("_b").isNotNull(), F.col("id"))).alias("_bank"), F.min_by("ifsc_code", F.when(F.col("ifsc_code").isNotNull(), F.col("id"))).alias("_code"))
    new = F.col("_old").isNull()
    status = F.coalesce("_status", F.when(new, "pending").otherwise(F.col("status")))
    stamp = F.when((F.col("_status") == "applied") & F.col("applied_date").isNull(), now).otherwise(F.col("applied_date"))
    pick = lambda mine, theirs: F.when(new, F.col(theirs)).otherwise(F.col(mine)).alias(mine)
    return both.join(known, keys, "left").select(*keys, pick("bank_name", "_bank"), pick("ifsc_code", "_code"), status.alias("status"), F.coalesce("_remarks", "remarks").alias("remarks"), stamp.alias("applied_date"))


def lien_status_sums(records: DataFrame) -> DataFrame:
    """One row of (lien_eligible_amount, status): eligible, applied and successful sums, and the share that succeeded."""
    amount = F.col("lien_eligible_amount")
    sums = records.agg(total(amount).alias("eligible"), total(amount, F.col("status") == "applied").alias("applied"), total(amount, F.col("status") == "success").alias("success"))
    return sums.withColumn("recovery_rate", F.when(F.col("eligible") > 0, F.round(F.col("success").cast("double") / F.col("eligible").cast("double"), 6)).otherwise(0.0))


def options(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are not blank, in order: what a list of choices offers."""
    return rows.select(F.col(column)).where(or_empty(F.col(column).cast("string")) != "").distinct().orderBy(column)


def earlier_sources(reports: DataFrame) -> DataFrame:
    """(ack_no, source_sha256, earlier_sha256): acknowledgements that came before from another file."""
    a, b = reports.alias("a"), reports.alias("b")
    met = a.join(b, (F.col("a.ack_no") == F.col("b.ack_no")) & (F.col("b.report_id") < F.col("a.report_id")) & (F.col("a.source_sha256") != F.col("b.source_sha256")))
    return met.select("a.ack_no", "a.source_sha256", F.col("b.source_sha256").alias("earlier_sha256")).distinct()


def newest(log: DataFrame, n: int = 100) -> DataFrame:
    return log.orderBy(F.desc("logged_at"), F.desc("id")).limit(n)
