"""Sinks: the tables of a report written as Parquet or CSV, and the audit log."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import attribution, behaviour, browse, calendar, graph, money, registry, scoring
from trailmark.operators.core import enrich, flag_duplicates, rollup, total
from trailmark.session import cut, stored


def report_tables(ledger: DataFrame) -> dict[str, DataFrame]:
    """All tables of a report by name over one ledger, which is kept once; the enriched ledger itself is ``transactions``."""
    flagged = stored(flag_duplicates(enrich(ledger)))
    rows = flagged.where("NOT is_duplicate")
    accounts = cut(rollup(rows))
    edges = graph.edges(rows)
    lien_rows = money.liens(accounts)
    flags = attribution.flagged_accounts(rows)
    scored = scoring.score(rows, accounts)
    by_key = calendar.one_key_tables(flagged)
    return {
        "transactions": flagged,
        "summary": money.summary(flagged, accounts),
        "layers": graph.layers(rows),
        "accounts": accounts,
        "liens": lien_rows,
        "liens_excluded": money.excluded_liens(accounts),
        "recovery": money.recovery(rows, accounts),
        "reconciliation": money.reconciliation(flagged),
        "victims": money.victims(rows),
        "edges": edges,
        "connectivity": graph.connectivity(edges),
        "collectors": graph.collectors(graph.connectivity(edges)),
        "cycles": graph.cycles(edges),
        "layer_flows": graph.layer_flows(rows),
        "exit_channels": behaviour.channels(rows),
        "exit_flags": behaviour.exit_flags(rows),
        "exit_flag_legs": behaviour.flag_legs(rows),
        "merchants": browse.merchants(flagged),
        "terminals": browse.atm_terminals(rows),
        "timeline": calendar.timeline(rows),
        "timeline_summary": calendar.timeline_summary(rows),
        **by_key,
        "data_quality": flags,
        "letters": attribution.letters(lien_rows),
        "letter_accounts": attribution.letter_accounts(lien_rows),
        "bank_rankings": browse.bank_rankings(lien_rows, rows),
        "repeat_accounts": registry.aggregate(registry.contributions(rows)),
        "scores": scored,
        "contributions": registry.contributions(rows),
    }


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder for each table; in CSV nested values are written as JSON."""
    for name, df in tables.items():
        if fmt == "csv":
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
            df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def exit_tables(rows: DataFrame, channel: str | None = None, flag: str | None = None) -> dict[str, DataFrame]:
    """The view of cash exits, of one channel or flag if they are given: exits, their flags, and the legs of those."""
    own = lambda df, **kw: reduce(DataFrame.where, [F.col(c) == F.lit(v) for c, v in kw.items() if v is not None], df)
    return {"exits": own(behaviour.exits(rows), channel=channel), "flags": own(behaviour.exit_flags(rows), channel=channel, flag=flag), "flag_legs": own(behaviour.flag_legs(rows), channel=channel, flag=flag)}


def drill_down(rows: DataFrame, title: str) -> dict[str, DataFrame]:
    """The legs of any drill-down, and one row of what they come to, as two tables to be written."""
    figures = rows.agg(F.lit(title).alias("title"), F.count("*").alias("legs"), total(F.col("transaction_amount")).alias("amount"), total(F.col("disputed_amount")).alias("disputed"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return {"figures": figures, "legs": rows}


def append_audit(spark: SparkSession, folder: str, entries: list[tuple[str, str, dict]]) -> None:
    """Appends (action, subject, details) to the audit log; details become JSON.

    Ids are microseconds since 1970 and the place among the entries, so that they grow from one append to the next.
    """
    rows = [(a, s, json.dumps(d, sort_keys=True), i) for i, (a, s, d) in enumerate(entries)]
    df = spark.createDataFrame(rows, "action string, subject string, details string, id long").withColumn("logged_at", F.current_timestamp())
    df = df.withColumn("id", F.unix_micros("logged_at") * 1000 + F.col("id"))
    df.write.mode("append").parquet(f"{folder}/audit_log")
