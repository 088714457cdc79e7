"""Results that are kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local session (tests) gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept_dir(spark: SparkSession) -> str:
    """Where this application keeps what is used more than once, until ``clean_up``."""
    return f"{shared_dir(spark)}/kept-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again, for what is used more than once; readers still prune and push down."""
    folder = f"{kept_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def clean_up(spark: SparkSession) -> None:
    """Drops all that this application has kept; results that were not read yet can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(kept_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
