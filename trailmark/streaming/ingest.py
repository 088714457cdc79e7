"""Ledger files as streams: new Parquet files of rows, and new workbooks, which are told apart by their content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.operators.core import enrich, total
from trailmark.operators.ingest import parse_workbooks
from trailmark.schema import LEDGER
from trailmark.sources.workbook import MAX_BYTES, rows_of


def ledger_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of canonical rows in ``folder``, as an unbounded ledger."""
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def daily_exits(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, channel, amount, count) of cash exits, kept up to date; legs later than ``late`` are left out of closed days."""
    exits = enrich(rows).where("row_kind = 'EXIT'").withColumn("at", F.col("transaction_date").cast("timestamp"))
    windows = exits.withWatermark("at", late).groupBy(F.window("at", "1 day"), F.col("cashout_mode").alias("channel"))
    return windows.agg(total(F.col("transaction_amount")).alias("amount"), F.count("*").alias("count")).select(F.to_date("window.start").alias("day"), "channel", "amount", "count")


def ingest(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``handle`` on every batch until all files that are there are done."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def workbook_files(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """(path, content, source_sha256) of new files in ``folder``; a content that came before, under whatever name, is left out.

    The state is one hash for each content.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return files.where(F.col("length") <= MAX_BYTES).select("path", "content", F.sha2("content", 256).alias("source_sha256")).dropDuplicates(["source_sha256"])


def ingest_workbooks(files: DataFrame, checkpoint: str, handle: Callable[[dict[str, DataFrame], DataFrame, int], None]) -> StreamingQuery:
    """Runs ``handle`` on what :func:`parse_workbooks` gives for every batch of new files, until all that are there are done.

    ``handle`` gets the tables, (path, source_sha256) of the files, and the
    number of the batch.  A batch that failed comes again with its number, which
    a versioned store takes as a key.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            if not df.isEmpty():
                handle(parse_workbooks(rows_of(df)), df.select("path", "source_sha256"), number)
        finally:
            df.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
