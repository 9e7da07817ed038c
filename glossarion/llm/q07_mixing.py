"""op7: all documents mixed to the sources' target weights."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .mixing import mix


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Equal rows share their copies."""
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", F.xxhash64(*docs.columns).alias("hash")
    )
    taken = (
        mix(rows, "doc_id", "text", "source", "hash")
        .groupBy(F.col("doc_id").alias("taken_id"), F.col("hash").alias("taken_hash"))
        .agg(F.sum("copies").cast("int").alias("copies"))
        .where("copies > 0")
    )
    whole = rows.groupBy("doc_id", "hash").agg(F.first("row").alias("row"))
    joined = whole.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("hash") == F.col("taken_hash")))
    repeated = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("row.*")
