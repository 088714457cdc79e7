"""Exact order statistics of a column of any length: the ranks are bracketed by sketches, and only the bracket is looked at again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that the driver looks at itself.
FEW = 10_000
#: Accuracy of the sketches: a bracket holds a few of as many parts of the rows.
ACCURACY = 10_000


def value_at(values: DataFrame, column: str, rank: int, n: int | None = None):
    """The value that ``rank`` others precede in order (0 is the least); nulls do not count.

    Each pass brackets the rank by two quantiles of a sketch of fixed size,
    counts what lies below and at its ends, and goes on strictly between them;
    a pass leaves a few ten-thousandths of the rows, and never the same ones.
    """
    v = F.col(column)
    left = values.select(v.alias("v")).where("v IS NOT NULL")
    n = left.count() if n is None else n
    if not 0 <= rank < n:
        raise IndexError(rank)
    v = F.col("v")
    while n > FEW:
        share = lambda r: min(1.0, max(0.0, r / n))
        slack = 2 * n / ACCURACY + 1
        low, high = left.agg(F.percentile_approx("v", [share(rank - slack), share(rank + slack)], ACCURACY)).first()[0]
        kind = left.schema["v"].dataType
        low, high = F.lit(low).cast(kind), F.lit(high).cast(kind)
        c = left.agg(*[F.count(F.when(x, 1)) for x in (v < low, v == low, (v > low) & (v < high), v == high)], F.min("v"), F.max("v"), F.max(low), F.max(high)).first()
        below, at_low, between, at_high = c[:4]
        if rank < below:  # outside of the bracket, which the sketch makes unlikely
            left, n = left.where(v < low), below
        elif rank < below + at_low:
            return c[6]
        elif rank < below + at_low + between:
            left, n, rank = left.where((v > low) & (v < high)), between, rank - below - at_low
        elif c[6] != c[7] and rank < below + at_low + between + at_high:
            return c[7]
        else:
            gone = below + at_low + (between + at_high if c[6] != c[7] else 0)
            left, n, rank = left.where(v > high), n - gone, rank - gone
    return sorted(r["v"] for r in left.collect())[rank]


def median(values: DataFrame, column: str) -> tuple[int, float | None]:
    """(n, median) of the values that are not null; the mean of the two in the middle if ``n`` is even."""
    some = values.select(F.col(column).alias("v")).where("v IS NOT NULL")
    n = some.count()
    if not n:
        return 0, None
    low = value_at(some, "v", (n - 1) // 2, n)
    if n % 2:
        return n, float(low)
    at = F.lit(low).cast(some.schema["v"].dataType)
    upto, above = some.agg(F.count(F.when(F.col("v") <= at, 1)), F.min(F.when(F.col("v") > at, F.col("v")))).first()
    return n, (float(low) + float(low if upto > n // 2 else above)) / 2
