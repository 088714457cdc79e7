"""As-of joins that no busy key can hold up: time is cut into slices, and what a slice lacks is carried over from later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice.  A key has a row for each slice in which something happens, and a slice as many rows as it has different times.
SLICE_SECONDS = 3600


def next_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], time: str = "t", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``left`` with ``next``: the first ``time`` of ``right`` with equal ``keys`` at or after its own, null if there is none.

    Rows of a key are dealt by slices of time.  Within a slice both sides are
    read in order of time; a row that nothing follows in its slice takes the
    first event of the next slice that has any.  Those are found in a table of
    slices, one row for each key and slice, so a key with a third of all rows is
    as many groups as it has slices.  Rows without a time or key have no next.
    """
    known = F.col(time).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    at = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / slice_seconds).alias("_slice")
    asked = left.where(known).select("*", at)
    moves = right.where(known).select(*keys, F.col(time).alias("_t"), at).distinct()
    by = [*keys, "_slice"]

    firsts = moves.groupBy(*by).agg(F.min("_t").alias("_first"))
    slices = firsts.unionByName(asked.select(*by).distinct().withColumn("_first", F.lit(None).cast(firsts.schema["_first"].dataType))).groupBy(*by).agg(F.min("_first").alias("_first"))
    after = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*by, F.min("_first").over(after).alias("_later"))

    rows = asked.select("*", F.col(time).alias("_t"), F.lit(True).alias("_asks")).unionByName(moves.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    # from the latest on, an event before the row that asks at the same time
    later = Window.partitionBy(*by).orderBy(F.desc("_t"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_next", F.min(F.when(~F.col("_asks"), F.col("_t"))).over(later)).where("_asks")
    found = met.join(carried, by).select(*left.columns, F.coalesce("_next", "_later").alias("next"))
    return found.unionByName(left.where(~known).withColumn("next", F.lit(None).cast(left.schema[time].dataType)))
