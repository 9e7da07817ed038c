"""Words and detailed results are there for every document."""

from glossarion.plans import catalogue

from .conftest import SF


def test_every_document_has_its_words_and_details(spark):
    counts = {r["doc_id"]: r["n"] for r in catalogue.QUERIES["tokenize_words"](spark, SF).groupBy("doc_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    words = catalogue.QUERIES["detect_words_documents"](spark, SF).select("doc_id", "pos").distinct().groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in words} == counts
    details = {r["doc_id"]: r for r in catalogue.QUERIES["detect_detailed_documents"](spark, SF).collect()}
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert details.keys() == ids and all(r["n_words"] == counts.get(k, 0) for k, r in details.items())
    assert all(r["aggregate"] and len(r["words_md5"]) == 32 for r in details.values())


def test_details_need_no_shuffle_and_agree_with_the_tables(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 --"), (-4, "It's 'the' ΣΊΣΥΦΟΣ zzyzx"), (-5, "the " * 3000)], "doc_id long, text string")
    docs = docs.unionByName(odd)
    detector = catalogue.detector(spark, SF)
    found = detector.detect_detailed(docs, "doc_id")
    found.explain()
    assert "Exchange hash" not in capsys.readouterr().out
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows.keys() == {r["doc_id"] for r in docs.collect()}
    listed = {}
    for r in detector.detect_words(docs, "doc_id").collect():
        listed.setdefault(r["doc_id"], {})[r["pos"]] = (r["token"], r["source"], [(x["lang"], round(x["score"], 9)) for x in r["scores"]])
    for k, r in rows.items():
        words = [(w["token"], w["source"], [(x["lang"], round(x["score"], 9)) for x in w["scores"]]) for w in r["words"]]
        assert words == [w for _, w in sorted(listed.get(k, {}).items())]
    whole = {r["doc_id"]: r["distribution"] for r in detector.detect_relational(docs, "doc_id").collect()}
    close = lambda found: None if found is None else [(x["lang"], round(x["score"], 9)) for x in found]
    assert all(close(r["aggregate"]) == close(whole[k]) for k, r in rows.items()) and rows[-1]["aggregate"] is None
