"""Connected components of an edge table by repeated contraction, as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import cut_small, hot_bound, join_counted, join_hot

#: Edges (16 bytes each) that one task joins at once; more are contracted in rounds until no more than that are left.
EDGES_AT_ONCE = 500_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = up[x], up[y]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[up]
        x, y = x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for b in batches]
    if parts:
        nodes, labels = joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=["node", "label"])


def connected_components(edges: DataFrame, n: int, at_once: int = EDGES_AT_ONCE) -> tuple[DataFrame, int]:
    """(node, label) and their number, of all nodes of ``edges`` (a long, b long), n rows; a label is the least node of its component.

    ``n`` of more than ``at_once`` are contracted: in every round each node
    points to the least node of its neighbourhood and all edges move to where
    their ends point; edges within one node vanish.  From the third round on
    "least" goes by a hash that changes with the round, so that long chains
    shrink by a constant factor.  What is left is joined in one task, and the
    rounds are composed from the last to the first.  The driver only counts.
    """
    left, n_left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), n
    steps: list[tuple[DataFrame, int]] = []
    while n_left > at_once:
        k = len(steps)
        rank = (lambda c: F.col(c)) if k < 2 else (lambda c, k=k: F.xxhash64(c, F.lit(k)))
        if not steps:
            left = cut_small(left.distinct())[0]
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"))
        mine = F.struct(rank("a").alias("r"), F.col("a").alias("to"))
        step, n_step = cut_small(near.select(F.col("a").alias("node"), F.least("m", mine)["to"].alias("to")))
        steps.append((step, n_step))
        x, y = (step.select(F.col("node").alias(c), F.col("to").alias(t)) for c, t in (("a", "x"), ("b", "y")))
        moved = join_hot(left, n_left, x, "a", F.col("b"))
        moved = join_hot(moved, n_left, y, "b", F.xxhash64("a", "x")).where("x <> y")
        left, n_left = cut_small(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = left.coalesce(1).mapInArrow(_join_all, "node long, label long")
    if not steps:
        return cut_small(labels)
    for step, n_step in reversed(steps):
        later = labels.select(F.col("node").alias("to"), F.col("label").alias("last"))
        labels = join_hot(step, n_step, later, "to", F.col("node"), keep=True).select("node", F.coalesce("last", "to").alias("label"))
        labels, n = cut_small(labels)
    least = labels.groupBy("label").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    return cut_small(join_counted(labels, least, "label", hot_bound(n), F.col("node")).select("node", F.col("least").alias("label")))
