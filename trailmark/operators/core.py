"""The shared core: kinds of legs, repeated legs, and the rollup by account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.text import account_key, or_empty
from trailmark.schema import LEG_GROUP, MONEY
from trailmark.session import stored

CASH_MODES = ("ATM", "POS", "AEPS")
#: What sums by account, edges and layers read of flagged legs.
SUMMED = ("id", "victim_key", "benef_key", "cash_account", "row_kind", "layer_no", "transaction_date", "transaction_amount", "disputed_amount", "beneficiary_bank", "ifsc_code", "is_duplicate")


def money(c: Column) -> Column:
    return F.coalesce(c.cast(MONEY), F.lit(0).cast(MONEY))


def total(c: Column, when: Column | None = None) -> Column:
    """A sum as DECIMAL(18,2), 0 of no rows."""
    return F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0)).cast(MONEY)


def enrich(ledger: DataFrame) -> DataFrame:
    """``ledger`` with account keys, ``row_kind`` (HOP, EXIT, HOLD, OTHER), ``cashout_mode``, ``cash_account`` and ``day``.

    A hold stays one even with a terminal; a leg with a cash mode or a terminal
    is an exit even if it names two accounts; a hop needs two different accounts.
    ``cashout_mode`` is ATM for any leg with a terminal.
    """
    mode = F.upper(or_empty(F.col("payment_mode")))
    terminal = or_empty(F.col("atm_id")) != ""
    out = ledger.withColumns(
        {
            "victim_key": account_key(F.col("victim_account")),
            "benef_key": account_key(F.col("beneficiary_account")),
            "transaction_amount": money(F.col("transaction_amount")),
            "disputed_amount": money(F.col("disputed_amount")),
        }
    )
    kind = (
        F.when(mode == "HOLD", "HOLD")
        .when(mode.isin(*CASH_MODES) | terminal, "EXIT")
        .when((F.col("victim_key") != "") & (F.col("benef_key") != "") & (F.col("victim_key") != F.col("benef_key")), "HOP")
        .otherwise("OTHER")
    )
    return out.withColumns(
        {
            "row_kind": kind,
            "cashout_mode": F.when(kind == "EXIT", F.when(terminal, "ATM").otherwise(mode)),
            "cash_account": F.when(F.col("benef_key") != "", F.col("benef_key")).otherwise(F.col("victim_key")),
            "day": F.to_date("transaction_date"),
        }
    )


def flag_duplicates(rows: DataFrame) -> DataFrame:
    """``rows`` (enriched) with ``is_duplicate``: of equal legs all but the one with the least id.

    Legs are equal by both accounts, time, amount, disputed amount and reference; the mode doesn't count.
    A source whose equal legs share a value has it as LEG_GROUP; rows that are
    dealt by it already are not dealt again.  It is dropped.
    """
    group = [c for c in rows.columns if c == LEG_GROUP]
    same = Window.partitionBy(*group, "victim_key", "benef_key", "transaction_date", "transaction_amount", "disputed_amount", F.coalesce("utr_no", F.lit("")))
    return rows.withColumn("is_duplicate", F.col("id") != F.min("id").over(same)).drop(LEG_GROUP)


def legs(ledger: DataFrame) -> DataFrame:
    """Enriched legs without the repeated ones."""
    return flag_duplicates(enrich(ledger)).where(~F.col("is_duplicate"))


def stored_legs(ledger: DataFrame, *more: str) -> DataFrame:
    """Flagged legs, kept once for figures that need them several times: the columns SUMMED and ``more``, as far as there are."""
    flagged = flag_duplicates(enrich(ledger))
    return stored(flagged.select(*[c for c in flagged.columns if c in SUMMED or c in more]))


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several tables of one row side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for f in frames for c in f.columns])


def hops(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row_kind") == "HOP")


def rollup(rows: DataFrame) -> DataFrame:
    """One row for each account: what it received, sent on, cashed out and what is held, and what a lien may take.

    Every leg becomes one event for each account that it touches, so that one
    shuffle does for all sums.
    """
    event = lambda account, role: F.struct(F.col(account).alias("account_no"), F.lit(role).alias("role"))
    events = F.when(F.col("row_kind") == "HOP", F.array(event("benef_key", "in"), event("victim_key", "out"))).when(F.col("row_kind") == "EXIT", F.array(event("cash_account", "cash"))).when(F.col("row_kind") == "HOLD", F.array(event("cash_account", "hold")))
    own = rows.withColumn("e", F.explode(events)).select("*", "e.account_no", "e.role").where("account_no <> ''")
    # sums of whole cents take a third of the room of decimal ones
    own = own.withColumns({c: (F.col(c).cast(MONEY) * 100).cast("long") for c in ("transaction_amount", "disputed_amount")})
    role = lambda r: F.col("role") == r
    amount, disputed = F.col("transaction_amount"), F.col("disputed_amount")
    total = lambda c, when: (F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)
    # the account's own bank is known from legs that it receives or that end with it
    mine = ~role("out")
    out = own.groupBy("account_no").agg(
        F.min_by("beneficiary_bank", F.when(mine & F.col("beneficiary_bank").isNotNull(), F.col("id"))).alias("bank_name"),
        F.min_by("ifsc_code", F.when(mine & F.col("ifsc_code").isNotNull(), F.col("id"))).alias("ifsc_code"),
        F.min(F.when(role("in"), F.col("layer_no"))).alias("layer_no"),
        total(amount, role("in")).alias("total_received"),
        total(disputed, role("in")).alias("disputed_received"),
        total(amount, role("out")).alias("onward_forwarded"),
        total(disputed, role("out")).alias("disputed_forwarded"),
        total(amount, role("cash")).alias("total_cashed_out"),
        total(amount, role("hold")).alias("total_on_hold"),
        F.countDistinct(F.when(role("in"), F.col("victim_key"))).alias("distinct_senders"),
        F.count(F.when(role("in"), 1)).alias("hops_in"),
        F.count("*").alias("txn_count"),
        F.min(F.when(role("in"), F.col("transaction_date"))).alias("first_received"),
    )
    left = F.greatest(F.col("total_received") - F.col("onward_forwarded") - F.col("total_on_hold") - F.col("total_cashed_out"), F.lit(0)).cast(MONEY)
    return out.withColumn("total_forwarded", (F.col("onward_forwarded") + F.col("total_cashed_out")).cast(MONEY)).withColumn("gross_balance", left).withColumn("lien_eligible_amount", F.greatest(F.least("gross_balance", "disputed_received"), F.lit(0)).cast(MONEY))
