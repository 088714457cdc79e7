"""Behaviour: cash exits and their flags, same-day exits, speed, investigation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.text import or_empty
from trailmark.operators.core import hops, one_row, total
from trailmark.operators.money import recovery
from trailmark.operators.selection import median
from trailmark.schema import MERCHANT_COUNT, MERCHANT_MINUTES, MULTI_ATM_COUNT, RAPID_COUNT, RAPID_MINUTES, RECOVERY_RATE_PCT, RESPONSE_GAP_DAYS
from trailmark.session import stored


def exits(rows: DataFrame) -> DataFrame:
    """Exits with their ``channel``, by payment mode; a leg with a terminal but no cash mode counts as ATM."""
    mode = F.upper(or_empty(F.col("payment_mode")))
    return rows.where("row_kind = 'EXIT'").withColumn("channel", F.when(mode.isin("POS", "AEPS"), mode).otherwise("ATM"))


def channels(rows: DataFrame) -> DataFrame:
    return exits(rows).groupBy("channel").agg(F.count("*").alias("count"), total(F.col("transaction_amount")).alias("amount"), total(F.col("disputed_amount")).alias("disputed"), F.countDistinct(F.when(or_empty(F.col("atm_id")) != "", F.col("atm_id"))).alias("unique_points"))


def top_exit_points(rows: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The ``top`` values of ``key`` (a terminal, a city) of each channel by amount."""
    sums = exits(rows).where(or_empty(F.col(key)) != "").groupBy("channel", key).agg(total(F.col("transaction_amount")).alias("amount"), F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("amount"), key))
    return sums.withColumn("rank", rank).where(F.col("rank") <= top)


def bursts(rows: DataFrame, key: str, minutes: int, least: int) -> DataFrame:
    """(key, count, total_amount, first, last): the densest stretch of ``minutes`` of each key with ``least`` legs or more.

    A leg exactly ``minutes`` later counts.  Of equal stretches the earliest is taken.
    """
    dated = rows.where(F.col("transaction_date").isNotNull() & (or_empty(F.col(key)) != "")).withColumn("_s", F.unix_seconds(F.col("transaction_date").cast("timestamp")))
    # legs of one second are one row; a second has its place in its own slice of time and, as one that follows, in the slice before,
    # so a busy key is many groups, and what a stretch holds are two running sums: its own slice from it on, and the next slice up to its end
    amount = F.col("transaction_amount")
    seconds = dated.groupBy(key, "_s").agg(F.count("*").alias("n"), F.sum(amount).alias("s"), F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last"))
    length = minutes * 60
    slice_of = F.floor(F.col("_s") / length)
    both = seconds.withColumn("_at", F.explode(F.array(F.struct(slice_of.alias("k"), F.col("_s").alias("p"), F.lit(True).alias("own")), F.struct((slice_of - 1).alias("k"), (F.col("_s") - length).alias("p"), F.lit(False).alias("own")))))
    group = Window.partitionBy(key, "_at.k")
    onward = group.orderBy(F.desc("_at.p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = group.orderBy("_at.p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own, later = F.col("_at.own"), ~F.col("_at.own")
    added = lambda c, nothing: F.coalesce(F.sum(F.when(own, F.col(c))).over(onward), nothing) + F.coalesce(F.sum(F.when(later, F.col(c))).over(upto), nothing)
    end = F.greatest(F.max(F.when(own, F.col("last"))).over(onward), F.max(F.when(later, F.col("last"))).over(upto))
    seen = both.withColumns({"_n": added("n", F.lit(0)), "_sum": added("s", F.lit(0).cast("decimal(18,2)")), "_end": end}).where(own)
    best = F.max_by(F.struct("_n", "_sum", "first", "_end"), F.struct("_n", (-F.col("_s")).alias("s")))
    found = seen.where(F.col("_n") >= least).groupBy(key).agg(best.alias("b"))
    return found.select(key, F.col("b._n").alias("count"), F.col("b._sum").cast("decimal(18,2)").alias("total_amount"), F.col("b.first").alias("first"), F.col("b._end").alias("last"))


def rapid_withdrawals(rows: DataFrame) -> DataFrame:
    return bursts(exits(rows).where("channel = 'ATM'"), "cash_account", RAPID_MINUTES, RAPID_COUNT)


def suspicious_merchants(rows: DataFrame) -> DataFrame:
    return bursts(exits(rows).where("channel = 'POS'"), "atm_id", MERCHANT_MINUTES, MERCHANT_COUNT)


def multi_atm(rows: DataFrame) -> DataFrame:
    """Accounts that used three or more machines on a day: their best day, the earliest of equal ones."""
    days = exits(rows).where("channel = 'ATM' AND day IS NOT NULL").where(or_empty(F.col("atm_id")) != "").groupBy("cash_account", "day").agg(F.countDistinct("atm_id").alias("distinct_atms"), F.count("*").alias("count"), total(F.col("transaction_amount")).alias("total_amount"))
    best = F.max_by(F.struct("day", "distinct_atms", "count", "total_amount"), F.struct("distinct_atms", (-F.unix_date("day")).alias("d")))
    return days.where(F.col("distinct_atms") >= MULTI_ATM_COUNT).groupBy("cash_account").agg(best.alias("b")).select("cash_account", "b.*")


def exit_flags(rows: DataFrame) -> DataFrame:
    """All three flags in one form: (channel, flag, subject, count, total_amount, why)."""
    minutes = F.timestamp_diff("MINUTE", F.col("first"), F.col("last"))
    form = lambda df, channel, flag, subject, why: df.select(F.lit(channel).alias("channel"), F.lit(flag).alias("flag"), F.col(subject).alias("subject"), "count", "total_amount", why.alias("why"))
    rapid = form(rapid_withdrawals(rows), "ATM", "rapid", "cash_account", F.concat("count", F.lit(" withdrawals in "), minutes, F.lit(" min")))
    many = form(multi_atm(rows), "ATM", "multi_atm", "cash_account", F.concat("distinct_atms", F.lit(" different ATMs on "), "day"))
    shops = form(suspicious_merchants(rows), "POS", "suspicious_merchant", "atm_id", F.concat("count", F.lit(" POS txns in "), minutes, F.lit(" min")))
    return rapid.unionByName(many).unionByName(shops)


def flag_legs(rows: DataFrame) -> DataFrame:
    """(channel, flag, subject, id, transaction_date, transaction_amount, why): the legs behind each flag of :func:`exit_flags`."""
    seen = exits(rows).withColumn("_s", F.unix_seconds(F.col("transaction_date").cast("timestamp")))

    def within(found: DataFrame, key: str, channel: str, flag: str, minutes: int) -> DataFrame:
        first = F.unix_seconds(F.col("first").cast("timestamp"))
        own = found.select(F.col(key).alias("subject"), first.alias("_first"), "count")
        met = seen.where(F.col("channel") == channel).join(own, (F.col(key) == F.col("subject")) & F.col("_s").between(F.col("_first"), F.col("_first") + minutes * 60))
        return met.select(F.lit(channel).alias("channel"), F.lit(flag).alias("flag"), "subject", "id", "transaction_date", "transaction_amount", F.concat(F.lit("one of "), "count", F.lit(f" within {minutes} min")).alias("why"))

    rapid = within(rapid_withdrawals(rows), "cash_account", "ATM", "rapid", RAPID_MINUTES)
    shops = within(suspicious_merchants(rows), "atm_id", "POS", "suspicious_merchant", MERCHANT_MINUTES)
    days = multi_atm(rows).select(F.col("cash_account").alias("subject"), F.col("day").alias("_day"), "distinct_atms")
    many = seen.where("channel = 'ATM'").where(or_empty(F.col("atm_id")) != "").join(days, (F.col("cash_account") == F.col("subject")) & (F.col("day") == F.col("_day")))
    many = many.select(F.lit("ATM").alias("channel"), F.lit("multi_atm").alias("flag"), "subject", "id", "transaction_date", "transaction_amount", F.concat(F.lit("one day at "), "distinct_atms", F.lit(" machines")).alias("why"))
    return rapid.unionByName(many).unionByName(shops)


def account_speed(rows: DataFrame) -> DataFrame:
    """(account_no, hours) from an account's first receipt to its first exit at or after it."""
    got = hops(rows).where("transaction_date IS NOT NULL").groupBy(F.col("benef_key").alias("account_no")).agg(F.min("transaction_date").alias("t"))
    cash = rows.where("row_kind = 'EXIT' AND transaction_date IS NOT NULL").select(F.col("cash_account").alias("account_no"), F.col("transaction_date").alias("c"))
    met = got.join(cash, "account_no").where("c >= t").groupBy("account_no", "t").agg(F.min("c").alias("c"))
    return met.select("account_no", (F.timestamp_diff("SECOND", F.col("t"), F.col("c")) / 3600).alias("hours"))


def cashout_speed(rows: DataFrame) -> DataFrame:
    """One row: accounts that cashed out what they received, and the exact median and the mean of their hours."""
    speeds = stored(account_speed(rows).select("hours"))
    mean = F.round(F.sum(F.round("hours", 6).cast("decimal(20,6)")) / F.count("*"), 4).cast("double")
    return speeds.agg(F.count("*").alias("account_count"), mean.alias("mean_hours")).select("account_count", F.round(F.lit(median(speeds, "hours")[1]).cast("double"), 4).alias("median_hours"), "mean_hours")


def band(value: Column, warn: float, danger: float) -> Column:
    return F.when(value <= warn, "ok").when(value <= danger, "warn").when(value.isNotNull(), "danger").otherwise("none")


def investigation_metrics(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row: days from fraud to the first hold, share of the loss that is secured, and their severities."""
    dates = rows.agg(F.min("day").alias("from_date"), F.min(F.when(F.col("row_kind") == "HOLD", F.col("day"))).alias("to_date"))
    one = one_row(dates, recovery(rows, accounts).select("base_amount", (F.col("on_hold") + F.col("refunded")).cast("decimal(18,2)").alias("secured_amount")))
    days = F.datediff("to_date", "from_date")
    pct = F.when(F.col("base_amount") > 0, F.round(F.col("secured_amount").cast("decimal(20,4)") * 100 / F.col("base_amount"), 1).cast("double"))
    rate = F.when(pct.isNull(), "none").when(pct <= RECOVERY_RATE_PCT[1], "danger").when(pct < RECOVERY_RATE_PCT[0], "warn").otherwise("ok")
    return one.select("from_date", "to_date", days.alias("response_gap_days"), band(days, *RESPONSE_GAP_DAYS).alias("response_gap_severity"), "base_amount", "secured_amount", pct.alias("recovery_pct"), rate.alias("recovery_severity"))
