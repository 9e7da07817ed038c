"""op10: byte-level BPE of all documents, encoded and decoded."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import documents

VOCABULARY = "byte_bpe_50k.tiktoken"


def token_digest(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    tokens = encode_documents(docs, path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *["ids"] * with_ids,
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(documents(spark, sf_dir))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes they decode to, for each row."""
    return token_digest(docs, with_ids=True)
