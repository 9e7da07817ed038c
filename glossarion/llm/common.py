"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship

#: Fixed by the contracts: what separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"
#: Rows handed to Python at once. Texts may be long, so batches stay short.
ARROW_ROWS = 400


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """array<string> of the runs of non-space characters; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.filter(F.split(trimmed, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def small_batches(spark: SparkSession) -> None:
    """Readies a session for the operators that run Python."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the cluster's shared checkpoint folder, so that
    they are computed once and outlive lost executors. The folder is the session's
    spark.checkpoint.dir; only where that is unset (tests) one is made here."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    done = df.checkpoint(eager=True)
    # What the rows came from is not read again; once the driver has collected its garbage, Spark removes those shuffle files.
    del df
    gc.collect()
    sc._jvm.System.gc()
    return done


def stored(df: DataFrame) -> DataFrame:
    """As cut, for larger tables: a Parquet table in the shared folder, so that columns are packed and read one by one."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stored-")
    path = f"{shared}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)
