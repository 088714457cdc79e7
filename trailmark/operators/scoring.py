"""Risk scores of accounts: weighted signals, each one a column, and what they say in words.

The curves of the signals are a reading of a written specification; where it is
silent they are assumptions of this repository (see the README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import or_empty
from trailmark.operators.behaviour import account_speed
from trailmark.operators.graph import severity
from trailmark.schema import AGGREGATOR_MIN, RISK_HIGH, RISK_MEDIUM, WEIGHTS

GROSS_TRACED_BELOW, GROSS_FLOW_FROM = 10_000, 100_000


def _clip(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def signals() -> dict[str, Column]:
    """Each signal between 0 and 1, from the columns that :func:`score` gathers."""
    ratio = F.coalesce(F.col("pass_through_ratio"), F.lit(0.0))
    cash_share = F.when(F.col("total_received") > 0, F.col("total_cashed_out").cast("double") / F.col("total_received").cast("double")).otherwise(0.0)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "pass_through": _clip(ratio / 0.9),
        "cashout_speed": F.coalesce(_clip((24.0 - F.col("hours")) / 23.0), F.lit(0.0)),
        "txn_count": _clip(F.log2(1.0 + F.col("txn_count")) / F.log2(F.lit(21.0))),
        "cross_case": _clip((F.col("cases") - 1) / 2.0),
        "geo_spread": _clip((F.col("places") - 1) / 3.0),
        "kyc_variance": _clip((F.col("names") - 1) / 2.0),
        "both_sheets": yes((F.col("hops_in") > 0) & (F.col("total_cashed_out") > 0)),
        "multi_channel": yes(F.col("channels") >= 2),
        "fan_in": _clip((F.col("distinct_senders") - 1) / 2.0),
        "high_cashout_ratio": yes(cash_share >= 0.8),
        "same_day_in_out": yes(F.col("same_day")),
        "in_degree_collector": yes(F.col("distinct_senders") >= AGGREGATOR_MIN),
    }


def score(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row for each account that received a hop: its signals, ``mule_score`` (no upper bound), label and reasons."""
    events = F.when(F.col("row_kind") == "HOP", F.array(F.struct(F.col("benef_key").alias("a"), F.lit(True).alias("mine")), F.struct(F.col("victim_key").alias("a"), F.lit(False).alias("mine")))).otherwise(F.array(F.struct(F.col("cash_account").alias("a"), F.lit(True).alias("mine"))))
    own = rows.withColumn("e", F.explode(events)).select("*", F.col("e.a").alias("account_no"), "e.mine").where("account_no <> ''")
    # what is counted once for each account: cases, places, names (a hub may have many of them) and channels
    written = lambda c: F.when(F.col("mine") & (or_empty(F.col(c)) != ""), F.col(c))
    exit_ = F.col("row_kind") == "EXIT"
    kinds = {"cases": F.col("ack_no"), "places": written("city"), "names": F.lower(written("beneficiary_name")), "channels": F.when(exit_, F.upper("payment_mode"))}
    pairs = [F.struct(F.lit(i).alias("kind"), v.alias("value")) for i, v in enumerate(kinds.values())]
    # days go with the first pair, which every leg has
    said = F.filter(F.array(*pairs), lambda p: (p["kind"] == 0) | p["value"].isNotNull())
    first = F.col("p.kind") == 0
    each = own.select("account_no", "mine", "row_kind", "day", F.explode(said).alias("p")).groupBy("account_no", F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).agg(
        F.min(F.when(first & F.col("mine") & (F.col("row_kind") == "HOP"), F.col("day"))).alias("first_day"),
        F.min(F.when(first & exit_, F.col("day"))).alias("first_cash_day"),
        F.min(F.when(first, F.col("day"))).alias("first_date"),
        F.max(F.when(first, F.col("day"))).alias("last_date"),
    )
    kept = each.groupBy("account_no").agg(
        *[F.count(F.when(F.col("kind") == i, F.col("value"))).alias(name) for i, name in enumerate(kinds)],
        *[F.min(c).alias(c) for c in ("first_day", "first_cash_day", "first_date")],
        F.max("last_date").alias("last_date"),
    )
    base = accounts.where("hops_in > 0").join(kept, "account_no").join(account_speed(rows), "account_no", "left")
    ratio = F.when(F.col("disputed_received") > 0, F.round(F.col("total_forwarded").cast("double") / F.col("disputed_received").cast("double"), 4))
    base = base.withColumns({"pass_through_ratio": ratio, "same_day": F.coalesce(F.col("first_day") == F.col("first_cash_day"), F.lit(False))})
    parts = signals()
    base = base.select("*", *[F.round(WEIGHTS[k] * c, 3).alias(f"points_{k}") for k, c in parts.items()])
    total = sum((F.col(f"points_{k}") for k in parts), F.lit(0.0))
    base = base.withColumn("mule_score", F.floor(total + 0.5).cast("int"))
    label = F.when(F.col("mule_score") >= RISK_HIGH, "HIGH").when(F.col("mule_score") >= RISK_MEDIUM, "MEDIUM").otherwise("LOW")
    words = lambda k, text: F.when(F.col(f"points_{k}") > 0, F.concat(text, F.lit(" (+"), F.round(f"points_{k}", 0).cast("int"), F.lit(")")))
    reasons = F.array_compact(
        F.array(
            words("pass_through", F.concat(F.lit("Passes on "), F.round(F.col("pass_through_ratio") * 100, 0).cast("long"), F.lit("% of what is traced"))),
            words("cashout_speed", F.concat(F.lit("Cashes out within "), F.round("hours", 1), F.lit(" hours"))),
            words("cross_case", F.concat(F.lit("Appears in "), "cases", F.lit(" cases"))),
            words("same_day_in_out", F.lit("Receives and cashes out on one day")),
            words("in_degree_collector", F.concat(F.lit("High fan-in collector: in-degree "), "distinct_senders")),
        )
    )
    flow = F.greatest("total_received", "onward_forwarded", "total_cashed_out", "total_forwarded")
    conduit = label.isin("HIGH", "MEDIUM") & (F.col("disputed_received") < GROSS_TRACED_BELOW) & (flow >= GROSS_FLOW_FROM)
    return base.withColumns({"risk_label": label, "suspicion_reasons": reasons, "gross_conduit": conduit, "aggregator_severity": severity(F.col("distinct_senders"))})


def risk_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.count_if(F.col("risk_label") == k).alias(k.lower()) for k in ("HIGH", "MEDIUM", "LOW")])
