"""op9: toxicity of all documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .toxicity import learn, score

THRESHOLD = 0.5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return learn(docs, labels.where(~held_out()))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learned(spark, docs, sf_dir)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, with the columns they came with."""
    model = learned(spark, docs, sf_dir)
    scored = score(docs.select(*docs.columns), model, keep=tuple(docs.columns), name="toxicity__")
    return scored.where(F.col("toxicity__") < THRESHOLD).select(*docs.columns)
