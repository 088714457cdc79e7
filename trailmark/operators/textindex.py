"""Text search that skips: a table of the trigrams of each block of rows tells which blocks can't have a match."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.browse import SEARCHED, filtered
from trailmark.session import kept_dir, stored

#: Rows of a block, about; a block is a folder that a search reads or skips.
BLOCK_ROWS = 100_000
#: Blocks that a search looks up at most by name; a text that more blocks may have is sought in all of them.
MOST_BLOCKS = 10_000
GRAM = 3
#: Bits of a code point.
POINT = 21


def grams_of(texts: pa.Array) -> np.ndarray:
    """The distinct trigrams of code points within the texts, each as one number."""
    texts = texts.drop_null()
    if not len(texts):
        return np.empty(0, dtype=np.int64)
    whole_text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py()
    points = np.frombuffer(whole_text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    n = np.asarray(pc.utf8_length(texts))
    ends = np.cumsum(n)
    if len(points) < GRAM:
        return np.empty(0, dtype=np.int64)
    codes = (points[:-2] << 2 * POINT) | (points[1:-1] << POINT) | points[2:]
    # the last two places of a text begin no trigram of it
    whole = np.ones(len(points), dtype=bool)
    whole[ends[n >= 1] - 1] = False
    whole[ends[n >= 2] - 2] = False
    return np.unique(codes[whole[: len(codes)]])


def block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, gram) of rows that come block by block: a block's trigrams are put together before they leave the task."""
    mask = (1 << POINT) - 1

    def out(block: int, found: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.unique(np.concatenate(found))
        texts = [chr(c >> 2 * POINT) + chr(c >> POINT & mask) + chr(c & mask) for c in codes.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(texts), pa.int32()), pa.array(texts, pa.string())], ["_block", "gram"])

    own, found = None, []
    for batch in batches:
        blocks = np.asarray(batch.column("_block"))
        for block in np.unique(blocks).tolist():
            if block != own:
                if found:
                    yield out(own, found)
                own, found = block, []
            part = batch.filter(pa.array(blocks == block))
            found = [np.unique(np.concatenate([*found, *[grams_of(part.column(c)) for c in SEARCHED]]))]
    if found:
        yield out(own, found)


class TextIndex:
    """``rows`` by ranges of their ids, and the trigrams of each range over the columns of SEARCHED, in lower case.

    The rows are made once, kept, and sorted by id once.  The table of trigrams
    has one row for each block and trigram in it, however often it is there.
    """

    def __init__(self, rows: DataFrame, folder: str | None = None, block_rows: int = BLOCK_ROWS, key: str = "id"):
        self.spark = rows.sparkSession
        self.folder = folder or f"{kept_dir(self.spark)}/search-{uuid.uuid4().hex}"
        rows = stored(rows)  # counting, sampling and dealing would make them three times
        n = max(1, -(-rows.count() // block_rows))
        ranged = rows.repartitionByRange(n, key).withColumn("_block", F.spark_partition_id())
        self.schema = ranged.schema
        ranged.write.partitionBy("_block").parquet(f"{self.folder}/rows")
        lowered = self.read().select("_block", *[F.lower(c).alias(c) for c in SEARCHED])
        own = lowered.mapInArrow(block_grams, "_block int, gram string").distinct()
        # a search looks up a few trigrams, so these are kept in their order
        own.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.folder}/grams")
        self.blocks = self.read().select("_block").distinct().count()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def may_have(self, text: str) -> list[int] | None:
        """Blocks that hold all trigrams of ``text``; None if it has none, or if most blocks do."""
        low = text.lower()
        grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not grams:
            return None
        table = self.spark.read.schema("_block int, gram string").parquet(f"{self.folder}/grams")
        met = table.where(F.col("gram").isin(grams)).groupBy("_block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        found = [r["_block"] for r in met.limit(MOST_BLOCKS + 1).collect()]
        return sorted(found) if len(found) <= MOST_BLOCKS else None

    def search(self, text: str) -> DataFrame:
        """The rows in which one of SEARCHED has ``text``, in any case and literally; blocks that can't have it are not read."""
        some = self.may_have(text)
        rows = self.read() if some is None else self.read().where(F.col("_block").isin(some) if some else F.lit(False))
        return filtered(rows, text=text).drop("_block")
