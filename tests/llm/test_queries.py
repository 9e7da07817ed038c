"""Queries against their SQL, and the pipeline's stages one after the other."""

import hashlib

import corpus_pipeline
import pytest
from glossarion.llm import entry
from glossarion.llm.common import documents

from ..conftest import SF, duck, same_rows


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same_rows(entry.queries()[name](spark, SF), *duck(SF, entry.oracle_sql()[name]))


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in entry.queries()) == list(range(1, 11))


def test_pipeline(spark):
    docs = documents(spark, SF)
    columns, before = docs.columns, docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "byte-level BPE":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs)
    tox, lines, near, mixed, tokens = kept
    assert tox.count() < before
    texts = [x for r in lines.collect() for x in r["text"].split("\n") if any(c.isalnum() for c in x)]
    assert len(texts) == len(set(texts))
    assert near.count() <= lines.count() and near.groupBy("doc_id").count().where("count > 1").isEmpty()
    assert mixed.groupBy("doc_id").count().where("count > 2").isEmpty()
    digests = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in mixed.collect()}
    got = tokens.collect()
    assert len(got) == mixed.count() and all(r["decoded_sha256"] == digests[r["doc_id"]] for r in got)
    assert corpus_pipeline.run(spark, SF).count() == len(got)
