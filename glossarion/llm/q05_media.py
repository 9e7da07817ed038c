"""op5: all documents stored as GIF and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .gif import store_documents


def media_digest(docs: DataFrame) -> DataFrame:
    last16 = F.substring("payload", -16, 16)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return store_documents(docs).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(last16).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("delays_cs="), joined("delays_cs"), F.lit(";histogram="), joined("histogram")).alias("feature"),
    )


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(documents(spark, sf_dir))
