"""Findings and next steps in words, from tables of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import indian_money
from trailmark.operators.core import one_row


def key_findings(summary: DataFrame, risks: DataFrame) -> DataFrame:
    """(place, finding): one sentence for each headline figure; ``summary`` and ``risks`` have one row."""
    lines = [
        F.concat(F.lit("Victims lost "), indian_money(F.col("victim_loss_amount")), F.lit(" over "), "total_layers", F.lit(" layers.")),
        F.concat(F.lit("Cashed out: "), indian_money(F.col("cashed_out")), F.lit("; on hold: "), indian_money(F.col("on_hold")), F.lit(".")),
        F.concat(F.lit("Still recoverable: "), indian_money(F.col("recoverable_residual")), F.lit("; liens could take "), indian_money(F.col("lien_table_total")), F.lit(".")),
        F.concat("high", F.lit(" accounts of high and "), "medium", F.lit(" of medium risk.")),
        F.concat("duplicate_count", F.lit(" repeated legs were set apart.")),
    ]
    return one_row(summary, risks).select(F.posexplode(F.array(*lines)).alias("place", "finding"))


def roadmap(summary: DataFrame, risks: DataFrame, quality: DataFrame) -> DataFrame:
    """(priority, title, description): P0 is to be done at once; steps without a cause are left out."""
    step = lambda when, p, title, text: F.when(when, F.struct(F.lit(p).alias("priority"), F.lit(title).alias("title"), text.alias("description")))
    steps = F.array_compact(
        F.array(
            step(F.col("lien_table_total") > 0, "P0", "Place liens", F.concat(F.lit("Balances of "), indian_money(F.col("lien_table_total")), F.lit(" can be held now."))),
            step(F.col("freeze_target_accounts") > 0, "P0", "Confirm banks of lien targets", F.concat("freeze_target_accounts", F.lit(" lien targets have doubtful banks."))),
            step(F.col("high") > 0, "P1", "Examine accounts of high risk", F.concat("high", F.lit(" accounts score high."))),
            step(F.col("cashed_out") > 0, "P2", "Ask for footage of cash exits", F.concat(indian_money(F.col("cashed_out")), F.lit(" left as cash."))),
            step(F.col("duplicate_count") > 0, "P3", "Check repeated legs", F.concat("duplicate_count", F.lit(" legs are listed more than once."))),
        )
    )
    return one_row(summary, risks, quality).select(F.inline(steps))
