"""One tokenizer for tables, functions and streams; nouns; the command line; the accuracy gate."""

import pytest
from glossarion import Detailed, LanguageDetector, Output, train_model
from glossarion.__main__ import main
from glossarion.functions import pytext
from glossarion.functions.text import tokens
from glossarion.nouns import detect_detailed_text, detect_texts
from glossarion.operators import evaluate
from glossarion.operators.tokenize import strict_tokens
from glossarion.plans import catalogue
from pyspark.sql import functions as F

TEXTS = [
    "हिन्दी शब्द", "cafe\u0301 na\u0308ive", "İstanbul I", "don't 'quoted' a1 42 --", "ﬁne x_y host.example.org", "", " \t", "ΟΔΟΣ", "e\u0301\u0301'", "\U0001d400bc",
]


@pytest.fixture(scope="module")
def model(spark):
    return train_model(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_plain_tokens_agree(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string").select("k", tokens(F.col("text")).alias("ts")).collect()
    assert {r["k"]: r["ts"] for r in rows} == {k: pytext.tokens(t) for k, t in enumerate(TEXTS)}
    assert pytext.tokens("हिन्दी") == ["हिन्दी"] and len(pytext.tokens("cafe\u0301 na\u0308ive")) == 2


def test_strict_tokens_agree(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    found = {}
    for r in strict_tokens(rows, "k").orderBy("k", "pos").collect():
        found.setdefault(r["k"], []).append(r["token"])
    assert found == {k: x for k, t in enumerate(TEXTS) if (x := pytext.tokens(t, "strict"))}
    assert pytext.tokens("ﬁne", "strict") == ["fine"]


@pytest.mark.parametrize("tokenizer", ["plain", "strict"])
def test_one_pass_agrees_with_the_relational_plan(spark, model, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate([*TEXTS, None])], "doc_id long, text string"))
    detector = LanguageDetector(model).with_tokenizer(tokenizer)
    shown = lambda df: sorted((r["doc_id"], r["lang"], r["score"] and round(r["score"], 6), r["distribution"] and len(r["distribution"])) for r in df.collect())
    assert shown(detector.detect(docs, "doc_id")) == shown(detector.detect_relational(docs, "doc_id"))


def test_no_language_is_unknown(spark, model):
    rows = spark.createDataFrame([(0, "the text"), (1, None)], "id int, text string")
    found = LanguageDetector(model).only([]).detect(rows, "id").orderBy("id").collect()
    assert (found[0]["lang"], found[0]["score"], found[1]["lang"]) == ("?", 1.0, None)


def test_nouns(spark, model):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'fr'").first()["text"]
    detector = LanguageDetector.supporting(model, only=["fr", "en"], unknown_threshold=0.3)
    one, nothing = detect_texts(detector, [text, "42"])
    assert isinstance(one, Output) and one.lang == "fr" and nothing == Output("?", 1.0, (("?", 1.0),))
    whole = detect_detailed_text(detector, text)
    assert isinstance(whole, Detailed) and whole.output() == one and {w.source for w in whole.words} <= {"dict", "ngram"}
    with pytest.raises(ValueError):
        LanguageDetector(model, tokenizer="none")


def test_commands(spark, tmp_path):
    docs = "/root/testdata/sf0.001/documents.parquet"
    assert "languages" in main(["train", docs, str(tmp_path / "m"), "--lists", str(tmp_path / "lists")], spark)
    assert (tmp_path / "lists" / "words" / "lang=en").is_dir()
    text = spark.read.parquet(docs).where("lang = 'de'").first()["text"]
    said = main(["detect", str(tmp_path / "m"), text, "--only", "de", "en"], spark).split("\n")
    assert said[0] == "de" and said[1].startswith("de ") and "\t" in said[2]
    assert main(["accuracy", str(tmp_path / "m"), docs], spark).startswith("# Accuracy")
    main(["sample", docs, str(tmp_path / "s"), "--per-lang", "3"], spark)
    assert spark.read.text(str(tmp_path / "s")).count() == 1 + 3 * 4


def test_accuracy_gate(spark):
    """At least 95 % of documents that the model has not seen."""
    assert evaluate.overall_accuracy(catalogue.judged(spark, "/root/testdata/sf0.01")).first()["pct"] >= 95
