"""op4: personal data in all documents. The counts are those of the base spans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .pii import KINDS, find_personal_data, learn


def _joined(spans):
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, shown), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: ~s["added"])
    found = find_personal_data(docs, learn(docs)).select("doc_id", "spans", base.alias("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
