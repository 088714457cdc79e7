"""A corpus, from documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which
the stage before has kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontaminate, langid, linededup, mixing, neardup
from trailmark.llm.common import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language that the labels teach go; ``lang`` is what is found, the source is the host whose prior counts.

    Null and empty texts and texts without letters go; null labels and sources
    say nothing.  Of equally likely languages the first by name counts, repeated
    rows are treated alike, and an empty table stays empty.
    """
    model = langid.fit_text_model(docs)
    return langid.keep_identified(docs, model, lang_col="lang").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go everywhere; ``n_chars`` counts what stays.

    Null texts become empty ones.  Rows without an id are told apart by their
    texts; repeated rows lose the same lines, and an empty table stays empty.
    """
    kept = linededup.drop_frequent_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays, of equal ids the one with the least hash of its text.

    Null and empty texts are one class, a null id counts as the least, of
    repeated rows one stays, and an empty table stays empty.
    """
    return neardup.drop_near_duplicates(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a shorter item whole, go.

    Null and empty texts and repeated rows stay, ids play no part, and an empty
    table stays empty; so does all of it if the benchmark has no words.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the weights of their sources, shuffled.

    A null source is a source.  A row is drawn by its id and its text, null or
    not; repeated rows are repeated alike, and an empty table stays empty.
    """
    mixed = mixing.mix_sources(docs)
    return mixed.select(*COLUMNS, F.col("_copy").alias("copy"), F.col("_n_copies").alias("n_copies"), F.col("_mix_key").alias("mix_key"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one keeps is written to the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs


#: Neither the text model of the first stage nor signatures can be expressed in SQL; the tests use brute force.
ORACLE_SQL: str | None = None
