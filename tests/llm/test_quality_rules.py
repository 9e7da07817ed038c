"""Fences by group that junk cannot widen."""

from glossarion.llm import q06_quality, quality
from glossarion.llm.common import documents

from ..conftest import SF, duck, same_rows

SF2 = "/root/testdata/sf0.01"


def test_rules_equal_their_sql(spark):
    for sf in (SF, SF2):
        same_rows(q06_quality.op6_quality_rules(spark, sf), *duck(sf, q06_quality.ORACLE))


def test_junk_fails_in_every_group(spark):
    sf = "/root/testdata/sf0.1"
    groups = documents(spark, sf).select("doc_id", "lang", "source")
    junk = "NOT base_failed AND n_symbols > 2 * n_words"
    found = q06_quality.op6_quality_rules(spark, sf).where(junk).join(groups, "doc_id").collect()
    assert len({(r["lang"], r["source"]) for r in found}) > 70 and not any(r["kept"] for r in found)


def test_a_document_may_stay_in_one_group_and_go_in_another(spark):
    """Long words are usual in the one source and not in the other; a group of few rows follows its language."""
    text = lambda n, i: " ".join(f"{chr(97 + i % 26)}{chr(97 + k)}".ljust(n + (k + i) % 3, "x") for k in range(24))
    rows = [(i, text(4, i), "en", "short") for i in range(60)] + [(100 + i, text(14, i), "en", "long") for i in range(60)]
    rows += [(200, text(14, 3), "en", "short"), (201, text(14, 3), "en", "long"), (202, text(4, 3), "en", "few"), (203, text(40, 3), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert not kept[200] and kept[201] and kept[202] and not kept[203]
    assert sum(kept.values()) == 122
