"""Time and place: days, weekdays, hours, states and cities, payment modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.text import or_empty
from trailmark.operators.core import one_row, total
from trailmark.operators.money import percent
from trailmark.session import stored

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def timeline(rows: DataFrame) -> DataFrame:
    """(date, total_amount, transaction_count, cashouts, layer_breakdown map) over all dated legs."""
    by_layer = rows.where("day IS NOT NULL").groupBy(F.col("day").alias("date"), "layer_no").agg(total(F.col("transaction_amount")).alias("a"), F.count("*").alias("n"), F.count(F.when(F.col("row_kind") == "EXIT", 1)).alias("c"))
    # a day has as many entries as there are layers
    return by_layer.groupBy("date").agg(total(F.col("a")).alias("total_amount"), F.sum("n").alias("transaction_count"), F.sum("c").alias("cashouts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("layer_no", F.lit(-1)), "a")))).alias("layer_breakdown"))


def running_total(days: DataFrame) -> DataFrame:
    """``days`` (date, total_amount) with ``cumulative``.

    Days are added up within their month and months before, so that no window
    holds all days in one task but the one over months.
    """
    month = F.trunc("date", "month")
    by_month = days.groupBy(month.alias("m")).agg(total(F.col("total_amount")).alias("a"))
    before = by_month.withColumn("_before", F.coalesce(F.sum("a").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("m", "_before")
    within = F.sum("total_amount").over(Window.partitionBy(month).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("_within", within).join(before, month == F.col("m")).select("date", "total_amount", (F.col("_within") + F.col("_before")).cast("decimal(18,2)").alias("cumulative"))


def timeline_summary(rows: DataFrame) -> DataFrame:
    first = lambda kind: F.min(F.when(F.col("row_kind") == kind, F.col("day")))
    one = rows.agg(F.min("day").alias("first_fraud_date"), first("EXIT").alias("first_cashout_date"), first("HOLD").alias("first_bank_action_date"), F.max("day").alias("_last"))
    return one.select("first_fraud_date", "first_cashout_date", "first_bank_action_date", F.datediff("_last", "first_fraud_date").alias("timeline_span_days"), F.datediff("first_bank_action_date", "first_fraud_date").alias("fraud_to_bank_action_days"))


def weekdays(rows: DataFrame) -> DataFrame:
    """All seven weekdays and ``Undated``, those without legs too."""
    name = F.coalesce(F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday("day")), F.lit("Undated"))
    sums = rows.groupBy(name.alias("weekday")).agg(F.count("*").alias("t"), total(F.col("transaction_amount")).alias("a"))
    bins = rows.sparkSession.createDataFrame([(i, d) for i, d in enumerate((*WEEKDAYS, "Undated"))], "place int, weekday string")
    return bins.join(sums, "weekday", "left").select("place", "weekday", F.coalesce("t", F.lit(0)).alias("txns"), F.coalesce("a", F.lit(0)).cast("decimal(18,2)").alias("total_amount"))


def hours(rows: DataFrame) -> DataFrame:
    """All 24 hours, those without legs too."""
    sums = rows.where("transaction_date IS NOT NULL").groupBy(F.hour("transaction_date").alias("hour")).agg(F.count("*").alias("t"), total(F.col("transaction_amount")).alias("a"))
    bins = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return bins.join(sums, "hour", "left").select("hour", F.coalesce("t", F.lit(0)).alias("txns"), F.coalesce("a", F.lit(0)).cast("decimal(18,2)").alias("total_amount"))


def daily_volume(rows: DataFrame) -> DataFrame:
    """Cash (ATM and POS) and transfers of each day; AEPS counts as a transfer."""
    cash = F.upper(or_empty(F.col("payment_mode"))).isin("ATM", "POS")
    return rows.where("day IS NOT NULL").groupBy("day").agg(total(F.col("transaction_amount"), ~cash).alias("transfer"), total(F.col("transaction_amount"), cash).alias("cash"))


def by_place(rows: DataFrame, key: str) -> DataFrame:
    """(key, amount, count, cashout_count, pct of the whole amount); blank places are ``Unknown``."""
    name = F.when(or_empty(F.col(key)) != "", F.trim(key)).otherwise("Unknown")
    sums = rows.groupBy(name.alias(key)).agg(total(F.col("transaction_amount")).alias("amount"), F.count("*").alias("count"), F.count(F.when(F.col("row_kind") == "EXIT", 1)).alias("cashout_count"))
    whole = rows.agg(total(F.col("transaction_amount"))).scalar()
    return sums.select("*", percent(F.col("amount"), whole).alias("pct"))


def payment_modes(rows: DataFrame) -> DataFrame:
    """(mode, count, amount, share_pct); blank modes are OTHERS."""
    mode = F.upper(or_empty(F.col("payment_mode")))
    sums = rows.groupBy(F.when(mode != "", mode).otherwise("OTHERS").alias("mode")).agg(F.count("*").alias("count"), total(F.col("transaction_amount")).alias("amount"))
    return sums.select("*", percent(F.col("amount"), rows.agg(total(F.col("transaction_amount"))).scalar()).alias("share_pct"))


def report_gap(rows: DataFrame, uploaded) -> DataFrame:
    """Days from the first dated leg to the upload."""
    return one_row(rows.agg(F.min("day").alias("first_day"))).select(F.datediff(F.lit(uploaded).cast("date"), "first_day").alias("days"))


#: Tables of one key that :func:`one_key_tables` makes, and their keys.
ONE_KEY = {"hours": "hour", "weekdays": "weekday", "states": "state", "cities": "city", "payment_modes": "mode", "daily_volume": "day"}


def one_key_tables(flagged: DataFrame) -> dict[str, DataFrame]:
    """Hours, weekdays, states, cities, payment modes and daily volume by grouping sets over one pass of ``flagged``.

    The same rows as ``hours`` and ``daily_volume`` of all legs and ``weekdays``,
    ``by_place`` and ``payment_modes`` of those that are not repeated.  The sums
    have one row for each value of a key and are kept for the tables.
    """
    fresh, amount, mode = ~F.col("is_duplicate"), F.col("transaction_amount"), F.upper(or_empty(F.col("payment_mode")))
    place = lambda key: F.when(or_empty(F.col(key)) != "", F.trim(key)).otherwise("Unknown")
    keyed = flagged.select(
        "day", fresh.alias("fresh"), amount.alias("amount"), mode.isin("ATM", "POS").alias("cash"), (F.col("row_kind") == "EXIT").alias("exit"), F.hour("transaction_date").alias("hour"),
        F.coalesce(F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday("day")), F.lit("Undated")).alias("weekday"), place("state").alias("state"), place("city").alias("city"), F.when(mode != "", mode).otherwise("OTHERS").alias("mode"),
    )
    keys = list(ONE_KEY.values())
    sums = keyed.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        *[F.grouping(k).alias(f"_{k}") for k in keys],
        F.count("*").alias("all_txns"), total(amount_ := F.col("amount")).alias("all_amount"), total(amount_, F.col("cash")).alias("cash"), total(amount_, ~F.col("cash")).alias("transfer"),
        F.count(F.when(F.col("fresh"), 1)).alias("txns"), total(amount_, F.col("fresh")).alias("amount"), F.count(F.when(F.col("fresh") & F.col("exit"), 1)).alias("exits"),
    )
    sums = stored(sums)
    of = lambda key: sums.where(F.col(f"_{key}") == 0)
    own = lambda key: of(key).where("txns > 0")
    whole = of("mode").agg(total(F.col("amount"))).scalar()
    bins = lambda names, schema: flagged.sparkSession.createDataFrame(names, schema)
    filled = lambda df, n, a: df.select(*df.columns[:-2], F.coalesce(n, F.lit(0)).alias("txns"), F.coalesce(a, F.lit(0)).cast("decimal(18,2)").alias("total_amount"))
    hour_bins = bins([(h,) for h in range(24)], "hour int").join(of("hour").where("hour IS NOT NULL").select("hour", "all_txns", "all_amount"), "hour", "left")
    weekday_bins = bins([(i, d) for i, d in enumerate((*WEEKDAYS, "Undated"))], "place int, weekday string").join(of("weekday").select("weekday", "txns", "amount"), "weekday", "left")
    out = {
        "hours": filled(hour_bins, F.col("all_txns"), F.col("all_amount")),
        "weekdays": filled(weekday_bins.select("place", "weekday", "txns", "amount"), F.col("txns"), F.col("amount")),
        "payment_modes": own("mode").select("mode", F.col("txns").alias("count"), "amount", percent(F.col("amount"), whole).alias("share_pct")),
        "daily_volume": of("day").where("day IS NOT NULL").select("day", "transfer", "cash"),
    }
    for name, key in (("states", "state"), ("cities", "city")):
        out[name] = own(key).select(key, "amount", F.col("txns").alias("count"), F.col("exits").alias("cashout_count"), percent(F.col("amount"), whole).alias("pct"))
    return out
