"""Operators that no busy key can hold up: as-of joins, exact selection, top cycles, deep pages."""

import datetime
import random
from bisect import bisect_left
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trailmark.operators import browse, graph, pages, selection
from trailmark.operators.timejoin import next_at_or_after
from trailmark.plans import catalog

SF = "/root/testdata/sf0.001"
DAY = datetime.datetime(2024, 1, 1)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


@pytest.mark.parametrize("slice_seconds", [60, 3600, 86400])
def test_next_at_or_after(spark, slice_seconds):
    r = random.Random(1)
    left = [(r.choice("abc"), i, at(r.randrange(4000)) if i % 9 else None) for i in range(300)] + [("a", 300, at(0)), ("a", 301, at(5000)), (None, 302, at(5))]
    right = [(r.choice("ab"), at(r.randrange(0, 4000, 7))) for _ in range(60)] * 2 + [("a", None), (None, at(6))]
    got = next_at_or_after(spark.createDataFrame(left, "k string, id long, t timestamp_ntz"), spark.createDataFrame(right, "k string, t timestamp_ntz"), ["k"], slice_seconds=slice_seconds)
    times = {k: sorted(t for x, t in right if x == k and t) for k in "abc"}

    def follows(k, t):
        i = bisect_left(times.get(k, []), t) if t else 0
        return times[k][i] if k and t and i < len(times[k]) else None

    assert sorted((x.id, x.next) for x in got.collect()) == [(i, follows(k, t)) for k, i, t in left]


def test_one_case_with_all_legs(spark):
    """The one key is dealt by slices: no task of the window sees more than its share."""
    n = 20_000
    left = spark.range(n).select(F.lit("case").alias("k"), F.timestamp_add("SECOND", F.col("id") * 60, F.lit(DAY).cast("timestamp_ntz")).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = next_at_or_after(left, left, ["k"])
        rows = [r[0] for r in met.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
        assert sum(rows) == n and max(rows) < 0.3 * n
        assert met.where("t <> next").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", ["double", "decimal(18,2)", "int"])
def test_exact_selection(spark, kind, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "ACCURACY", 20)
    r = random.Random(2)
    for values in ([r.gauss(0, 1000) for _ in range(3001)], [1.0] * 500 + [2.0] * 500, [1.0] * 900 + [r.random() * 9 for _ in range(100)], [5.0], [r.choice([0.0, 7.0, 1e9]) for _ in range(800)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 7, "v double").select(F.col("v").cast(kind).alias("v"))
        own = sorted(x.v for x in df.where("v IS NOT NULL").collect())
        for rank in {0, 1, len(own) // 3, len(own) // 2, len(own) - 1} & set(range(len(own))):
            assert selection.value_at(df, "v", rank) == own[rank]
        n, median = selection.median(df, "v")
        assert n == len(own) and median == pytest.approx(float(df.agg(F.median("v")).first()[0]))
    assert selection.median(df.where("false"), "v") == (0, None)


def test_top_cycles_need_few_edges(spark):
    r = random.Random(3)
    rows = {}
    for _ in range(4000):
        a, b = r.sample(range(900), 2)
        rows[(f"n{a:03}", f"n{b:03}")] = Decimal(r.randrange(1, 3000))
    edges = spark.createDataFrame([(a, b, m, 1, ["B"]) for (a, b), m in rows.items()], "source string, destination string, amount decimal(18,2), txns long, banks array<string>")
    every = sorted(((-x.amount, x.length, "; ".join(x.path)) for x in graph.cycles(edges, 4).collect()))
    assert len(every) > 50
    for first in (100, 800, 100_000):
        got = [(-x.amount, x.length, "; ".join(x.path)) for x in graph.top_cycles(edges, 10, 4, first).collect()]
        assert got == every[:10]
    few = edges.where("amount < 20")
    assert graph.top_cycles(few, 10, 4, 5).count() == min(10, graph.cycles(few, 4).count())


def test_deep_pages(spark):
    rows = catalog._flagged(catalog.ledger(spark, SF)).select("id", "transaction_date", "transaction_amount").cache()
    for sort in ({"by": "transaction_amount"}, {"by": "transaction_date", "descending": False, "nulls_last": True}):
        index = pages.RankIndex(rows, **sort)
        every = [x.id for x in browse.ordered(rows, **sort).collect()]
        assert index.total == len(every) and index.pages(50) == -(-len(every) // 50)
        for number in (1, 2, index.pages(50) // 2, index.pages(50), index.pages(50) + 1):
            assert [x.id for x in index.page(number, 50).collect()] == every[(number - 1) * 50 : number * 50]
        assert [x.id for x in index.page(3, 499).collect()] == every[998:1497]
    assert pages.RankIndex(rows.limit(0)).page(1).count() == 0


def test_search_skips_blocks(spark):
    from trailmark.operators.textindex import TextIndex

    rows = catalog._flagged(catalog.ledger(spark, SF)).select("id", *browse.SEARCHED)
    index = TextIndex(rows, block_rows=300)
    assert index.blocks > 15
    for text in ("u1234", "U12", "name 7", "%", "12", "", "no such text", "P1\nN"):
        assert sorted(r.id for r in index.search(text).collect()) == sorted(r.id for r in browse.filtered(rows, text=text).collect())
    rare = next(r.utr_no for r in rows.where("utr_no IS NOT NULL").orderBy("id").take(1))
    assert len(index.may_have(f"{rare} ") or []) < index.blocks and len(index.may_have(rare)) < index.blocks / 2
    assert index.may_have("no such text") == [] and index.may_have("ab") is None
    assert TextIndex(rows.limit(0)).search("abc").count() == 0


def test_one_pass_for_tables_of_one_key(spark):
    from trailmark.operators import calendar
    from trailmark.operators.core import stored_legs

    flagged = stored_legs(catalog.ledger(spark, SF), "day", "payment_mode", "state", "city")
    rows = flagged.where("NOT is_duplicate")
    tables = calendar.one_key_tables(flagged)
    want = {"hours": calendar.hours(flagged), "weekdays": calendar.weekdays(rows), "states": calendar.by_place(rows, "state"), "cities": calendar.by_place(rows, "city"), "payment_modes": calendar.payment_modes(rows), "daily_volume": calendar.daily_volume(flagged)}
    assert set(tables) == set(want)
    for name, df in want.items():
        assert sorted(map(tuple, tables[name].select(*df.columns).collect())) == sorted(map(tuple, df.collect())), name
        # what is left to be run reads the sums only
        assert "victim_key" not in tables[name]._jdf.queryExecution().optimizedPlan().toString()


def test_kept_data_goes(spark):
    from pathlib import Path

    from trailmark.session import clean_up, kept_dir

    catalog.QUERIES["layer_analysis"](spark, SF).collect()
    folder = Path(kept_dir(spark).removeprefix("file:"))
    assert list(folder.iterdir())
    clean_up(spark)
    assert not folder.exists()


@pytest.mark.parametrize("most", [0, 10])
def test_ids_over_ranges_of_files(spark, monkeypatch, most):
    from trailmark.operators import ingest

    monkeypatch.setattr(ingest, "BROADCAST_FILES", most)
    rows = spark.createDataFrame([(f"f{f:02}", s, r, "A") for f in range(30) for s in range(2) for r in range(1, f % 4 + 2)], "path string, sheet_no int, r long, ack_no string")
    got = sorted((r.utr_no, r.id) for r in ingest.with_ids(rows.withColumn("utr_no", F.col("path")), 7, first=100).collect())
    assert [i for _, i in got] == list(range(101, 101 + rows.count()))  # in order of the files
