"""What grows with the tables: expressions are made once, busy seconds are counted once, wide rows are dealt once."""

import datetime

from pyspark.sql import functions as F

from trailmark.functions import parse
from trailmark.functions.banks import with_bank
from trailmark.operators import behaviour
from trailmark.sources.adapter import ledger

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_matched_once(spark):
    cells = spark.createDataFrame([("1",)], "c string")
    assert plan(cells.select(parse.parse_date(F.col("c")).alias("x"))).count("regexp") <= 12
    assert plan(cells.select(parse.parse_amount(F.col("c")).alias("x"))).count("regexp") <= 8
    named = with_bank(spark.createDataFrame([("SBIN0004321", "SBI")], "ifsc_code string, raw_beneficiary_bank string")).select("bank_flag")
    assert plan(named).lower().count("regexp") <= 8
    assert named.collect() == [("IFSC_TEXT_MISMATCH",)]


def test_values_that_are_made_once(spark):
    cells = ["31/12/2024 12:05:00 AM", "2024-02-30", "02.13.99", "45292.5", "19:09:PM", None, " n/a ", "1/2/03 25:00"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select(parse.parse_date(F.col("c")).alias("at"), "i").orderBy("i")
    at = datetime.datetime
    assert [r.at for r in got.collect()] == [at(2024, 12, 31, 0, 5), None, at(1999, 2, 13), at(2024, 1, 1, 12), None, None, None, at(2003, 2, 1)]


def test_lines_are_dealt_by_order_only(spark):
    joins = [line for line in plan(ledger(spark, SF).select("id", "city")).splitlines() if "Join" in line]
    at = lambda key: next(i for i, line in enumerate(joins) if key in line)
    assert at("l_orderkey") < at("o_custkey")


def test_bursts_are_running_sums(spark):
    """A thousand legs in an hour of one terminal: no window looks at a leg's whole stretch again."""
    start = datetime.datetime(2024, 1, 1, 0, 30)
    times = [start + datetime.timedelta(seconds=s, microseconds=m) for s in (*range(0, 7200, 9), 100, 100, 3700) for m in (0, 5)]
    rows = spark.createDataFrame([("T", t, i % 7) for i, t in enumerate(times)], "k string, transaction_date timestamp_ntz, a int").withColumn("transaction_amount", F.col("a").cast("decimal(18,2)"))
    found = behaviour.bursts(rows, "k", 60, 3)
    assert "rangeframe, currentrow$(), 3600" not in plan(found).lower()
    floor = lambda t: t.replace(microsecond=0)

    def stretch(t):
        within = [(u, i % 7) for i, u in enumerate(times) if 0 <= (floor(u) - floor(t)).total_seconds() <= 3600]
        return len(within), sum(a for _, a in within), min(u for u, _ in within), max(u for u, _ in within)

    best = max((stretch(t) for t in times), key=lambda x: (x[0], -floor(x[2]).timestamp()))
    assert [(r[1], int(r[2]), r[3], r[4]) for r in found.collect()] == [best]


def test_merged_ranges_meet_rows_of_their_block_only(spark):
    """A range in each of many rows: no join of all ranges of a sheet with all of its rows."""
    from trailmark.operators import ingest
    from trailmark.sources.workbook import CELLS

    at = lambda r, c, value, to_r=None, to_c=None: ("a.xlsx", 0, "s", r, c, value, to_r, to_c, None)
    cells = [at(r, 0, f"A{r}", r + 2, 0) for r in range(0, 6000, 3)] + [at(r, 1, "x") for r in range(0, 6000, 2)] + [at(7000, 2, "wide", 9000, 4), at(8001, 3, "y"), at(8500, 4, " ")]
    filled = ingest.fill_merged(spark.createDataFrame(cells, CELLS))
    assert "BETWEEN" not in plan(filled).upper() and not any("Join" in x and ">=" in x for x in plan(filled).splitlines())
    got = {(r.r, r.c): r.value for r in filled.where("c <> 1").collect()}
    used = {r for r in range(6000) if r % 3 == 0 or r % 2 == 0}
    wide = {(7000, 2): "wide", (7000, 3): "wide", (8001, 2): "wide", (8001, 3): "y", (8500, 4): " "}
    assert got == {(r, 0): f"A{r - r % 3}" for r in used} | wide


def test_equal_legs_are_found_where_their_order_is(spark):
    """Lines are dealt by their order once; no second shuffle of whole legs by all that equal ones share."""
    from trailmark.operators.core import legs

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = legs(ledger(spark, SF)).select("id", "benef_key")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    dealt = [s for s in steps if "Exchange hashpartitioning" in s]
    assert any("l_orderkey" in s for s in dealt) and not any("victim_key" in s for s in dealt)


def test_distinct_values_of_accounts_are_not_multiplied(spark):
    """Cases, places, names and channels are counted by one aggregation that neither copies wide rows nor collects sets."""
    from trailmark.operators import scoring
    from trailmark.operators.core import rollup, stored_legs

    rows = stored_legs(ledger(spark, SF), "day", "ack_no", "city", "beneficiary_name", "payment_mode").where("NOT is_duplicate")
    scored = scoring.score(rows, rollup(rows)).select("account_no", "cases", "places", "names", "channels")
    assert "collect_set" not in plan(scored) and "ObjectHashAggregate" not in scored._jdf.queryExecution().executedPlan().toString()
    mine = rows.where("row_kind = 'HOP' AND benef_key <> ''").select(F.col("benef_key").alias("account_no"), "ack_no", "city", "beneficiary_name", F.lit(None).cast("string").alias("mode"))
    out = rows.where("row_kind = 'HOP'").select("victim_key", "ack_no", F.lit(None), F.lit(None), F.lit(None))
    rest = rows.where("row_kind <> 'HOP'").select("cash_account", "ack_no", "city", "beneficiary_name", F.when(F.col("row_kind") == "EXIT", F.col("payment_mode")))
    want = mine.union(out).union(rest).groupBy("account_no").agg(*[F.countDistinct(c) for c in ("ack_no", "city", "beneficiary_name", "mode")])
    assert scored.count() > 0 and scored.exceptAll(want.join(scored, "account_no", "left_semi")).count() == 0


def test_index_of_texts_makes_rows_once(spark):
    """Making the index runs the rows that it is given one time; its trigrams are those of each column, of any letters."""
    from trailmark.operators import browse
    from trailmark.operators.textindex import TextIndex

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    texts = [("Ab\nc", None, "", "İx€y", "zz"), ("AB", "abC", "q😀r", None, "zzz")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts * 50)], "id long, " + ", ".join(f"{c} string" for c in browse.SEARCHED))
    index = TextIndex(rows.mapInArrow(seen, rows.schema), block_rows=30)
    assert made.value == 100 and index.blocks > 1
    low = spark.createDataFrame([(t,) for r in texts for t in r], "t string").selectExpr("lower(t) AS t").collect()
    want = {r.t[i : i + 3] for r in low if r.t for i in range(len(r.t) - 2)}
    assert {r.gram for r in spark.read.parquet(f"{index.folder}/grams").collect()} == want
    assert index.search("BC").count() == 50 and index.search("b\nC").count() == 50 and index.search("Q😀").count() == 50 and index.search("nothing").count() == 0


def test_receipts_are_found_once(spark):
    """Both readers of first receipts in the join by time read kept ones."""
    from trailmark.operators import graph
    from trailmark.operators.core import stored_legs

    rows = stored_legs(ledger(spark, SF), "ack_no").where("NOT is_duplicate")
    assert "min(struct" not in plan(graph.forward_hours(rows)).lower()
