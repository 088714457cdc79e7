"""A small trail for demonstrations: fifty legs in layers 0 to 4, the same on every call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.banks import with_bank
from trailmark.schema import MONEY

LEGS = 50
#: First leg of each layer after the first.
LAYER_STARTS = (5, 15, 27, 40)
RAILS = ("IMPS", "UPI", "NEFT")


def demo_trail(spark: SparkSession, report_id: int = 1) -> DataFrame:
    """Ledger rows: money goes down three accounts a layer and leaves as cash from the third on; the first accounts come again in layer 2."""
    i = F.col("i")
    layer = sum((F.when(i >= s, 1).otherwise(0) for s in LAYER_STARTS), F.lit(0))
    rows = spark.range(LEGS).withColumnRenamed("id", "i").withColumn("layer_no", layer)
    cash = (F.col("layer_no") == 4) | ((F.col("layer_no") == 3) & (i % 3 == 0))
    rail = F.get(F.array(*map(F.lit, RAILS)), (i % 3).cast("int"))
    mode = F.when(cash, F.when(i % 4 == 3, "POS").otherwise("ATM")).otherwise(rail)
    holder = lambda n, k: F.concat(F.lit("5000"), (n * 3 + k % 3).cast("string"))
    sender = F.when(F.col("layer_no") == 0, F.lit("DEMOVICTIM")).otherwise(holder(F.col("layer_no"), i))
    again = (F.col("layer_no") == 2) & (i % 4 == 0)
    receiver = F.when(cash, sender).when(again, holder(F.lit(1), i)).otherwise(holder(F.col("layer_no") + 1, i + 1))
    amount = ((5 - F.col("layer_no")) * 10000 + i * 500).cast(MONEY)
    at = F.timestamp_add("HOUR", F.col("layer_no") * 6 + i % 5, F.lit("2024-03-01 09:00:00").cast("timestamp_ntz"))
    out = rows.select(
        (i + 1).alias("id"),
        F.lit(report_id).cast("long").alias("report_id"),
        F.lit("DEMO-1").alias("ack_no"),
        F.lit("2024-03-02").cast("date").alias("complaint_date"),
        sender.alias("victim_account"),
        F.lit("Demo Bank").alias("victim_bank"),
        receiver.alias("beneficiary_account"),
        F.lit("Demo Bank").alias("raw_beneficiary_bank"),
        F.concat(F.lit("Holder "), receiver).alias("beneficiary_name"),
        F.lit(None).cast("string").alias("ifsc_code"),
        at.alias("transaction_date"),
        amount.alias("transaction_amount"),
        amount.alias("disputed_amount"),
        F.concat(F.lit("DEMO"), i + 1).alias("utr_no"),
        mode.alias("payment_mode"),
        F.col("layer_no"),
        F.when(mode == "ATM", F.concat(F.lit("DEMOATM"), i % 5)).alias("atm_id"),
        F.when(cash, F.concat(F.lit("Demo place "), i % 5)).alias("atm_location"),
        F.lit("Demo city").alias("city"),
        F.lit("Demo state").alias("state"),
        F.concat(mode, F.lit(" demo")).alias("remarks"),
    )
    return with_bank(out)
