"""Deep pages: a ledger sorted once by ranges, whose counts tell which ranges a page lies in."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.browse import PAGE_MOST, order_of
from trailmark.session import kept_dir


class RankIndex:
    """``rows`` in the order of :func:`trailmark.operators.browse.ordered`, kept in ranges, and how many rows come before each.

    Making it sorts all rows once; a page then reads the one or two ranges that
    it lies in, however far back it is.  The driver has one count for each range.
    """

    def __init__(self, rows: DataFrame, folder: str | None = None, **sort):
        self.spark, self.sort = rows.sparkSession, sort
        self.folder = folder or f"{kept_dir(self.spark)}/ranks-{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(*order_of(**sort)).withColumn("_range", F.spark_partition_id())
        self.schema = ranged.schema
        ranged.write.partitionBy("_range").parquet(self.folder)
        counts = self.read().groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
        self.ranges = [r["_range"] for r in counts]
        self.before = [0, *accumulate(r["n"] for r in counts)]

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    @property
    def total(self) -> int:
        return self.before[-1]

    def pages(self, size: int = 50) -> int:
        return -(-self.total // max(1, min(size, PAGE_MOST)))

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """The rows of a page, in order; none beyond the last one."""
        size = max(1, min(size, PAGE_MOST))
        first = min((max(1, number) - 1) * size, self.total)
        last = min(first + size, self.total)
        low = max(0, bisect_right(self.before, first) - 1)
        high = max(low, bisect_right(self.before, last - 1) - 1) if last > first else low
        some = self.read().where(F.col("_range").isin(self.ranges[low : high + 1])).drop("_range")
        return some.orderBy(*order_of(**self.sort)).offset(first - self.before[low]).limit(last - first)
