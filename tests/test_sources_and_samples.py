import bz2
import tarfile

import pytest
from glossarion.functions.langs import news_corpus
from glossarion.functions.text import normalise, ns_per_token, outcome, thousands, throughput_k
from glossarion.operators import evaluate, sample
from glossarion.operators.train import model_of
from glossarion.sources import readers, writers
from pyspark.sql import functions as F


def test_readers(spark, tmp_path):
    (tmp_path / "f.txt").write_text("The 9\nbad\nthe 5\n123 4\nof x\nof 3\n")
    rows = readers.frequency_list(spark, str(tmp_path / "f.txt"), "en").orderBy("line").collect()
    assert [(r["token"], r["freq"]) for r in rows] == [("the", 9), ("of", 3)]
    (tmp_path / "t.bz2").write_bytes(bz2.compress(b"1\teng\tA sentence that is long enough.\n2\teng\tshort\n3\tjpn\tanother that is long enough\n"))
    assert [r["lang"] for r in readers.sentence_pairs(spark, str(tmp_path / "t.bz2")).collect()] == ["en"]
    (tmp_path / "w.txt").write_text("one\n\nthree\n")
    assert {(r["token"], r["rnk"]) for r in readers.word_list(spark, str(tmp_path / "w.txt"), "en").collect()} == {("one", 0), ("three", 2)}
    (tmp_path / "g.txt").write_text("FLOOR\t-9.5\nabc\t-1.5\nbad\tx\n")
    tri, floor = readers.trigram_list(spark, str(tmp_path / "g.txt"), "en")
    assert tri.first()["lp"] == -1.5 and tri.count() == 1 and floor.first()["lp"] == -9.5
    (tmp_path / "a.tsv").write_text("# note\n\nen\thello there\nbroken\nde\thallo\tdu\n")
    assert {tuple(r) for r in readers.labelled_tsv(spark, str(tmp_path / "a.tsv")).collect()} == {("en", "hello there"), ("de", "hallo\tdu")}
    (tmp_path / "j.json").write_text('["a", "b \\"c\\""]')
    (tmp_path / "l.json").write_text('"x",\n"y"\n')
    assert [r["text"] for r in readers.json_strings(spark, str(tmp_path / "j.json")).orderBy("pos").collect()] == ["a", 'b "c"']
    assert [r["text"] for r in readers.json_strings(spark, str(tmp_path / "l.json")).orderBy("pos").collect()] == ["x", "y"]
    (tmp_path / "n.txt").write_text("1\tone two\nx\n2\t\n")
    assert readers.numbered_sentences(spark, str(tmp_path / "n.txt"), "en").count() == 1
    (tmp_path / "dev").mkdir()
    (tmp_path / "dev" / "eng_Latn.dev").write_text("a\n\n b \n")
    assert [tuple(r) for r in readers.split_corpus(spark, str(tmp_path), "dev", ("en",)).collect()] == [("en", "a"), ("en", "b")]


def test_archives(spark, tmp_path):
    for name, text in (("x/eng_news-sentences.txt", "1\tone two\n2\tthree\n"), ("x/words.txt", "1\tno\n"), ("f/eng_Latn.dev", "a\n\n b\n")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        archive.add(tmp_path / "in", "in")
    path = str(tmp_path / "a.tar.gz")
    assert [tuple(r) for r in readers.tar_sentences(spark, path, "en").orderBy("id").collect()] == [("en", 1, "one two"), ("en", 2, "three")]
    assert [tuple(r) for r in readers.tar_split(spark, path, "dev", ("en",)).orderBy("line").collect()] == [("en", 0, "a"), ("en", 2, "b")]
    with pytest.raises(ValueError, match="de"):
        readers.tar_split(spark, path, "dev", ("en", "de"))
    assert news_corpus("en", "100K") == "eng_news_2024_100K" and news_corpus("pl", "1M") == "pol_news_2023_1M"


def test_writers(spark, tmp_path):
    freq = spark.createDataFrame([("en", "the", 5), ("en", "of", 3)], "lang string, token string, freq long")
    model = model_of(freq, ["en"])
    writers.words(model.dictionary, str(tmp_path / "w"))
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/w/lang=en").collect()] == ["the", "of"]
    writers.trigrams(model.trigrams, model.floors, str(tmp_path / "t"))
    assert spark.read.text(f"{tmp_path}/t/lang=en").first()["value"].startswith("FLOOR\t")
    rows = spark.createDataFrame([(0, "en", "a\tb\nc")], "pos int, lang string, text string")
    writers.evaluation_tsv(rows, str(tmp_path / "e"))
    assert [tuple(r) for r in readers.labelled_tsv(spark, str(tmp_path / "e")).collect()] == [("en", "a b c")]
    writers.json_array(rows, str(tmp_path / "j"))
    assert readers.json_strings(spark, str(tmp_path / "j")).first()["text"] == "a\tb\nc"


def test_samples(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], f"text {k}") for k in range(20)], "doc_id long, lang string, text string")
    picked = sample.sample_per_language(docs, 3)
    assert picked.groupBy("lang").count().where("count = 3").count() == 2
    assert picked.orderBy("doc_id").collect() == sample.sample_per_language(docs, 3).orderBy("doc_id").collect()
    assert sample.shuffled(docs).count() == 20
    times = spark.createDataFrame([(x,) for x in (5, 1, 3, 9)], "x int")
    assert times.agg(sample.upper_median("x").alias("m")).first()["m"] == 5
    assert times.agg(sample.true_median("x").alias("m")).first()["m"] == 4.0
    work = sample.by_work(spark.createDataFrame([("a b c",), (None,), ("a",)], "text string")).collect()
    assert [r["work"] for r in work] == [0, 1, 3]
    assert sample.representative(docs, "doc_id").first()["doc_id"] == 0


def test_evaluation(spark):
    rows = spark.createDataFrame([("en", "en"), ("en", "de"), ("de", "de"), ("fr", "?")], "expected string, predicted string")
    assert evaluate.overall_accuracy(rows).first()["pct"] == 50.0
    pr = {r["lang"]: r for r in evaluate.precision_recall_f1(rows).collect()}
    assert pr["de"]["p"] == 0.5 and pr["de"]["r"] == 1.0 and pr["fr"]["f1"] == 0.0
    assert evaluate.confusion_matrix(rows, ["de", "en", "?"]).where("expected = 'en'").first()["de"] == 1
    assert evaluate.compare_fixtures(rows, rows.where("expected = 'en'")).where("pct_b IS NULL").count() == 2
    assert evaluate.markdown(evaluate.accuracy_by_language(rows)).startswith("| lang | n |")
    assert evaluate.overall_accuracy(rows.limit(0)).first()["pct"] == 0.0
    merged = evaluate.merged_misses(a=rows, b=rows.where("expected = 'en'")).orderBy("lang").collect()
    assert [(r["lang"], r["predicted"], r["n"], r["fixtures"]) for r in merged] == [("en", "de", 2, ["a", "b"]), ("fr", "?", 1, ["a"])]
    assert evaluate.report(rows).startswith("# Accuracy\n\n2 / 4 = 50.00 %") and "| expected | ? | de | en | fr |" in evaluate.report(rows)


def test_functions(spark):
    row = spark.sql("SELECT 'ﬁN' AS t, CAST(NULL AS string) AS z, 0.9D AS r").select(
        normalise(F.col("t")).alias("a"), normalise(F.col("z")).alias("b"), outcome(F.col("r")).alias("c")
    ).first()
    assert tuple(row) == ("fin", None, "win")
    numbers = spark.sql("SELECT 1499 AS a, 1500 AS b, 0 AS z, 8.0D AS ms, 4000 AS n").select(
        thousands(F.col("a")), thousands(F.col("b")), ns_per_token(F.col("ms"), F.col("n")), ns_per_token(F.col("ms"), F.col("z")),
        throughput_k(F.col("n"), F.lit(2.0)), throughput_k(F.col("n"), F.lit(0.0)),
    ).first()
    assert tuple(numbers) == (1, 2, 2000.0, None, 2.0, None)
