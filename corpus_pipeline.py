"""A corpus in five stages: toxic documents go, repeated lines go, one document of each
group of near duplicates stays, sources are mixed to their target weights, and what is
left is encoded with byte-level BPE.

Each stage reads what the one before it wrote: ``run`` writes its rows as Parquet into
the session's shared checkpoint folder, so executors may be lost at any time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from glossarion.llm.q03_neardup import near_duplicate_stage
from glossarion.llm.q07_mixing import mixing_stage
from glossarion.llm.q08_lines import line_dedup_stage
from glossarion.llm.q09_toxicity import toxicity_stage
from glossarion.llm.q10_bpe import bpe_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: Training and SimHash cannot be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
