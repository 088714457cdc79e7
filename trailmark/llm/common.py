"""Small Spark helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary folder; on a
    cluster that is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context.getCheckpointDir()


#: Rows of a small table that one task reads.
ROWS_A_TASK = 100_000
#: Keys that can be hot at most: those that hold more than one row in so many.
HOT_KEYS = 10_000
#: Rows of a key below which it is never hot.
HOT_ROWS = 1000


def cut_small(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows; the result has as few partitions as the rows ask for."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return out.coalesce(max(1, -(-n // ROWS_A_TASK))), n


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def hot_bound(n_rows: int) -> int:
    """Keys with more rows than this are hot; of ``n_rows`` rows at most HOT_KEYS keys are, so that a table of them can be broadcast."""
    return max(HOT_ROWS, n_rows // HOT_KEYS)


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], bound: int, *spread: Column, keep: bool = False) -> DataFrame:
    """``rows`` with the columns of ``counted``, which has each ``key`` (one or more columns) at most once and its number of rows as ``n``.

    Keys of more than ``bound`` rows (see ``hot_bound``) are looked up in a
    broadcast table; their rows aren't dealt by the key but by ``spread``, one
    for each column of it, so that no task gets all of them.  Rows without a
    match go, or have nulls if they are to be kept.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in counted.columns if c not in keys]
    side = lambda some, name: some.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*rest).alias(f"{name}_v"))
    on = lambda x, y: reduce(and_, [F.col(x.format(k)) == F.col(y.format(k)) for k in keys])
    known = rows.join(F.broadcast(side(counted.where(F.col("n") > bound), "hot")), on("{}", "hot_{}"), "left")
    known = known.withColumns({f"own_{k}": F.when(F.col("hot_v").isNull(), F.col(k)).otherwise(x) for k, x in zip(keys, spread, strict=True)})
    known = known.join(side(counted.where(F.col("n") <= bound), "cold"), on("own_{}", "cold_{}"), "left").withColumn("found_v", F.coalesce("hot_v", "cold_v"))
    return (known if keep else known.where("found_v IS NOT NULL")).select(*rows.columns, *[F.col("found_v")[c].alias(c) for c in rest])


def join_hot(rows: DataFrame, n_rows: int, values: DataFrame, key: str, spread: Column, keep: bool = False) -> DataFrame:
    """``rows``, ``n_rows`` of them, with the columns of ``values``, which has each ``key`` at most once; keys may be hot."""
    if n_rows <= HOT_ROWS:
        return rows.join(values, key, "left" if keep else "inner")
    counted = values.join(rows.groupBy(key).agg(F.count("*").alias("n")), key)
    return join_counted(rows, counted, key, hot_bound(n_rows), spread, keep=keep).drop("n")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, in any case: those that an operator adds take their place."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df if len(kept) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in kept])
