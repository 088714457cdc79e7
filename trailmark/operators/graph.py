"""The directed graph of hops: edges, degrees, collectors, layers, cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.text import or_empty
from trailmark.operators.core import hops, one_row, total
from trailmark.operators.selection import median, value_at
from trailmark.operators.timejoin import next_at_or_after
from trailmark.schema import AGGREGATOR_MIN, AGGREGATOR_RED, COLLECTOR_TOP, CYCLE_MAX_LENGTH, CYCLE_TOP, FANOUT_HIGH
from trailmark.session import cut, stored

#: Strongest edges among which the first cycles are sought, and by how much more if there are too few.
CYCLE_EDGES, CYCLE_MORE = 2000, 8


def _bank() -> Column:
    """The bank of a leg, null if it is blank."""
    return F.when(or_empty(F.col("beneficiary_bank")) != "", F.col("beneficiary_bank"))


def edges(rows: DataFrame) -> DataFrame:
    """(source, destination, amount, disputed, txns, layers, banks): one row for each pair of accounts."""
    return hops(rows).groupBy(F.col("victim_key").alias("source"), F.col("benef_key").alias("destination")).agg(
        total(F.col("transaction_amount")).alias("amount"),
        total(F.col("disputed_amount")).alias("disputed"),
        F.count("*").alias("txns"),
        F.array_sort(F.collect_set("layer_no")).alias("layers"),
        F.array_sort(F.collect_set(_bank())).alias("banks"),
    )


def connectivity(graph: DataFrame) -> DataFrame:
    """(account_no, in_degree, out_degree, total_in, total_out, bank, is_collector) of every account with an edge."""
    side = lambda me, other, way: F.struct(F.col(me).alias("account_no"), F.col(other).alias("other"), F.lit(way).alias("way"))
    both = graph.select(F.explode(F.array(side("destination", "source", "in"), side("source", "destination", "out"))).alias("e"), "amount", "banks").select("e.*", "amount", "banks")
    into, out = F.col("way") == "in", F.col("way") == "out"
    found = both.groupBy("account_no").agg(
        F.count(F.when(into, 1)).alias("in_degree"),
        F.count(F.when(out, 1)).alias("out_degree"),
        total(F.col("amount"), into).alias("total_in"),
        total(F.col("amount"), out).alias("total_out"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(into, F.col("banks")))))), "; ").alias("bank"),
    )
    return found.withColumn("is_collector", F.col("in_degree") >= 2)


def collectors(accounts: DataFrame, top: int = COLLECTOR_TOP) -> DataFrame:
    return accounts.where("is_collector").orderBy(F.desc("in_degree"), F.desc("total_in"), "account_no").limit(top)


def severity(in_degree):
    return F.when(in_degree >= AGGREGATOR_RED, "danger").when(in_degree >= AGGREGATOR_MIN, "warn")


def aggregators(accounts: DataFrame, rolled: DataFrame) -> DataFrame:
    """Accounts that three or more senders pay into, with what is left there."""
    some = accounts.where(F.col("in_degree") >= AGGREGATOR_MIN).select("account_no", F.col("in_degree").alias("distinct_senders"), severity(F.col("in_degree")).alias("severity"))
    return some.join(rolled.select("account_no", "total_received", F.col("gross_balance").alias("held"), "layer_no"), "account_no", "left")


def aggregator_summary(some: DataFrame) -> DataFrame:
    some = stored(some.select("distinct_senders", "held", "total_received"))
    sums = some.agg(F.count("*").alias("count"), F.max("distinct_senders").alias("max_fan_in"), total(F.col("held")).alias("total_held"), total(F.col("total_received")).alias("total_received"))
    return sums.select("count", "max_fan_in", F.lit(median(some, "distinct_senders")[1]).cast("double").alias("median_fan_in"), "total_held", "total_received")


def layers(rows: DataFrame) -> DataFrame:
    """One row for each layer with hops or exits: volumes, fan-out to the next layer, ranks of banks, time to forward."""
    hop = F.col("row_kind") == "HOP"
    own = rows.where("row_kind IN ('HOP', 'EXIT')")
    base = own.groupBy("layer_no").agg(
        F.count(F.when(hop, 1)).alias("txn_count"),
        F.countDistinct(F.when(hop, F.col("benef_key"))).alias("account_count"),
        total(F.col("transaction_amount"), hop).alias("total_amount"),
        total(F.col("disputed_amount"), hop).alias("disputed_amount"),
        F.count(F.when(~hop, 1)).alias("cashout_count"),
    )
    following = base.select((F.col("layer_no") - 1).alias("layer_no"), F.col("account_count").alias("_next"))
    ratio = F.when((F.col("_next") > 0) & (F.col("account_count") > 0), F.round(F.col("_next") / F.col("account_count"), 4))
    ranked = hops(rows).where(_bank().isNotNull()).groupBy("layer_no", _bank().alias("bank")).agg(F.count("*").alias("n"))
    best = ranked.groupBy("layer_no").agg(F.count("*").alias("bank_count"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "bank"))).alias("_r"))
    named = F.transform(F.slice("_r", 1, 3), lambda x: F.concat(x["bank"], F.lit(" ("), -x["m"], F.lit(")")))
    return (
        base.join(following, "layer_no", "left").join(best, "layer_no", "left").join(forward_hours(rows), "layer_no", "left")
        .select("layer_no", "txn_count", "account_count", F.coalesce("bank_count", F.lit(0)).alias("bank_count"), "total_amount", "disputed_amount", "cashout_count", ratio.alias("fan_out_ratio"), F.coalesce(ratio >= FANOUT_HIGH, F.lit(False)).alias("fan_out_high"), F.array_join(named, "; ").alias("top_banks"), "avg_forward_time_hours")
    )


def forward_hours(rows: DataFrame) -> DataFrame:
    """(layer_no, avg_forward_time_hours): from an account's first receipt in a layer to the case's next hop a layer on."""
    dated = hops(rows).where("transaction_date IS NOT NULL")
    got = dated.groupBy("layer_no", "benef_key").agg(F.min(F.struct("transaction_date", "ack_no")).alias("g")).select("layer_no", F.col("g.transaction_date").alias("t"), F.col("g.ack_no").alias("ack_no"))
    # the join reads its left side twice
    receipts = stored(got.groupBy("ack_no", (F.col("layer_no") + 1).alias("layer"), "t").agg(F.count("*").alias("n")))
    moves = dated.select("ack_no", F.col("layer_no").alias("layer"), F.col("transaction_date").alias("t"))
    met = next_at_or_after(receipts, moves, ["ack_no", "layer"]).where("next IS NOT NULL")
    seconds = F.timestamp_diff("SECOND", F.col("t"), F.col("next"))
    return met.groupBy((F.col("layer") - 1).alias("layer_no")).agg(F.round(F.sum(seconds * F.col("n")) / F.sum("n") / 3600, 2).alias("avg_forward_time_hours"))


def layer_flows(rows: DataFrame) -> DataFrame:
    """(source, target, gross, disputed, txns) between layers, and from layers to the sinks of cash and holds."""
    node = lambda n: F.concat(F.lit("layer:"), n)
    hop = F.col("row_kind") == "HOP"
    first = F.col("layer_no") == hops(rows).agg(F.min("layer_no")).scalar()
    some = rows.where("row_kind IN ('HOP', 'EXIT', 'HOLD')")
    source = F.when(hop & first, F.lit("origin")).when(hop, node(F.col("layer_no") - 1)).otherwise(node(F.col("layer_no")))
    target = F.when(hop, node(F.col("layer_no"))).when(F.col("row_kind") == "EXIT", "sink:cashout").otherwise("sink:hold")
    return some.select(source.alias("source"), target.alias("target"), "transaction_amount", "disputed_amount").groupBy("source", "target").agg(total(F.col("transaction_amount")).alias("gross"), total(F.col("disputed_amount")).alias("disputed"), F.count("*").alias("txns"))


def core_edges(graph: DataFrame, rounds: int) -> DataFrame:
    """Edges of which ``rounds`` others can come before and after; shorter dead ends are on no cycle.

    What is left beyond them costs some work, not a wrong result, so the number
    of rounds does not depend on the longest chain.
    """
    left = cut(graph)
    for _ in range(rounds):
        has_out, has_in = left.select(F.col("source").alias("destination")).distinct(), left.select(F.col("destination").alias("source")).distinct()
        left = cut(left.join(has_out, "destination", "left_semi").join(has_in, "source", "left_semi").select(graph.columns))
    return left


def _between(graph: DataFrame) -> DataFrame:
    return graph.where("source <> destination").select("source", "destination", "amount", "txns", "banks")


def cycles(graph: DataFrame, longest: int = CYCLE_MAX_LENGTH) -> DataFrame:
    """(path, length, amount, txns, banks) of all simple cycles of two to ``longest`` edges, each from its least account.

    Paths of up to half the length leave the least account of a cycle, others
    come back to it, and neither goes below it; they are joined where they meet.
    So no path is longer than half a cycle, and hubs are passed less often.
    """
    half = -(-longest // 2)
    step = core_edges(_between(graph), half)

    def walks(here: str, there: str, most: int) -> dict[int, DataFrame]:
        """By length: (start, last, nodes after the start in the order of walking, ...)."""
        more = step.select(F.col(here).alias("last"), F.col(there).alias("to"), F.col("amount").alias("a"), F.col("txns").alias("n"), F.col("banks").alias("b"))
        ways = {1: step.where(F.col(here) < F.col(there)).select(F.col(here).alias("start"), F.col(there).alias("last"), F.array(there).alias("nodes"), "amount", "txns", "banks")}
        for k in range(2, most + 1):
            longer = ways[k - 1].join(more, "last").where((F.col("to") > F.col("start")) & ~F.array_contains("nodes", F.col("to")))
            ways[k] = cut(longer.select("start", F.col("to").alias("last"), F.array_append("nodes", F.col("to")).alias("nodes"), F.least("amount", "a").alias("amount"), (F.col("txns") + F.col("n")).alias("txns"), F.array_union("banks", "b").alias("banks")))
        return ways

    forth, back = walks("source", "destination", half), walks("destination", "source", longest // 2)
    found = []
    for length in range(2, longest + 1):
        a, b = -(-length // 2), length // 2
        home = back[b].select("start", "last", F.expr("slice(reverse(nodes), 2, 100)").alias("rest"), F.col("amount").alias("a"), F.col("txns").alias("n"), F.col("banks").alias("b"))
        met = forth[a].join(home, ["start", "last"]).where(~F.arrays_overlap("nodes", "rest"))
        found.append(met.select(F.concat(F.array("start"), "nodes", "rest").alias("path"), F.lit(length).alias("length"), F.least("amount", "a").alias("amount"), (F.col("txns") + F.col("n")).alias("txns"), F.array_sort(F.array_union("banks", "b")).alias("banks")))
    return reduce(DataFrame.unionByName, found)


def top_cycles(graph: DataFrame, top: int = CYCLE_TOP, longest: int = CYCLE_MAX_LENGTH, first: int = CYCLE_EDGES) -> DataFrame:
    """The ``top`` cycles by their least edge, shorter ones first among equals, then by path.

    The amount of a cycle is that of its weakest edge, so cycles among the
    strongest edges come before all others.  Edges are added by falling amount,
    all of one amount together, until enough cycles stand; only if there are not
    so many cycles at all, every edge takes part.
    """
    core = stored(core_edges(_between(graph), -(-longest // 2)))
    n, most = core.count(), first
    best = [F.desc("amount"), "length", F.array_join("path", "; ")]
    while most < n:
        least = F.lit(value_at(core, "amount", n - most, n)).cast(core.schema["amount"].dataType)
        found = cut(cycles(core.where(F.col("amount") >= least), longest))
        if found.count() >= top:
            return found.orderBy(*best).limit(top)
        most *= CYCLE_MORE
    return cycles(core, longest).orderBy(*best).limit(top)


def cycle_totals(rows: DataFrame, graph: DataFrame, longest: int = CYCLE_MAX_LENGTH) -> DataFrame:
    """One row: all cycles, how many of them have two edges, and the legs that an account pays to itself."""
    found = cycles(graph, longest).agg(F.count("*").alias("cycles"), F.count(F.when(F.col("length") == 2, 1)).alias("two_way"))
    loops = rows.agg(F.count(F.when((F.col("row_kind") == "OTHER") & (F.col("victim_key") != "") & (F.col("victim_key") == F.col("benef_key")), 1)).alias("self_loops"))
    return one_row(found, loops)
