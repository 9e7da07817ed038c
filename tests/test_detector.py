from dataclasses import replace

import pytest
from glossarion import LanguageDetector, Model, supported_languages, train_model
from glossarion.functions.langs import checked
from glossarion.functions.text import tokens, trigrams
from glossarion.operators.score import word_scores
from glossarion.operators.tokenize import strict_tokens
from glossarion.operators.train import MOST_SENT
from glossarion.streaming.scorer import Scorer
from pyspark.sql import functions as F

#: Our own sentences, several a language, so that each has words and trigrams of its own.
CORPUS = {
    "en": "the weather was fine and the children walked slowly through the old garden with their mother when the bells rang",
    "de": "das wetter war schön und die kinder gingen langsam durch den alten garten mit ihrer mutter als die glocken läuteten",
    "fr": "le temps était beau et les enfants marchaient lentement dans le vieux jardin avec leur mère quand les cloches sonnaient",
    "ru": "погода была хорошая и дети медленно шли через старый сад со своей матерью когда звонили колокола",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, v) for k, v in CORPUS.items() for _ in range(3)]
    return train_model(spark.createDataFrame(rows, "lang string, text string")).cached()


def one(spark, model, text, **kw):
    d = LanguageDetector(model, **kw)
    return d.detect(spark.createDataFrame([(0, text)], "id int, text string"), "id").first()


@pytest.mark.parametrize("text, want", [
    ("I'M IN 802 area-code foo_bar", ["i'm", "in", "area", "code", "foo", "bar"]), ("2pm i18n 007", ["2pm", "i18n"]),
    ("''quoted'' it's", ["quoted", "it's"]), ("a\tb\nc", ["a", "b", "c"]), ("", []), (" ", []), ("Straße ÉTÉ мир", ["straße", "été", "мир"]),
])
def test_tokens(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("x")).first()
    assert row["x"] == want


def test_strict_tokens(spark):
    rows = spark.createDataFrame([(1, "café a.b ﬁn"), (2, "plain it's 5"), (3, None), (4, "")], "id int, text string")
    found = {(r["id"], r["pos"]): r["token"] for r in strict_tokens(rows, "id").collect()}
    assert found[1, 0] == "café" and "fin" in found.values() and [found[2, k] for k in (0, 1)] == ["plain", "it's"]
    assert {k[0] for k in found} == {1, 2}


@pytest.mark.parametrize("word, want", [("hi", ["^^h", "^hi", "hi$", "i$$"]), ("a", ["^^a", "^a$", "a$$"]), ("", ["^^$", "^$$"])])
def test_trigrams(spark, word, want):
    assert spark.createDataFrame([(word,)], "t string").select(trigrams(F.col("t")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("lang", CORPUS)
def test_each_language(spark, model, lang):
    row = one(spark, model, CORPUS[lang])
    assert row["lang"] == lang and len(row["distribution"]) == 4
    assert abs(sum(x["score"] for x in row["distribution"]) - 1) < 1e-9


def test_unknown_and_null(spark, model):
    docs = spark.createDataFrame([(1, ""), (2, " \t\n"), (3, "12 34"), (4, None)], "id int, text string")
    found = {r["id"]: (r["lang"], r["score"]) for r in LanguageDetector(model).detect(docs, "id").collect()}
    assert found == {1: ("?", 1.0), 2: ("?", 1.0), 3: ("?", 1.0), 4: (None, None)}
    assert one(spark, model, CORPUS["en"] + " " + CORPUS["de"], threshold=0.99)["lang"] == "?"
    assert LanguageDetector(model).detect(docs.limit(0), "id").count() == 0


def test_mixed_text_and_repeats(spark, model):
    shares = {x["lang"]: x["score"] for x in one(spark, model, CORPUS["en"] + " " + CORPUS["ru"])["distribution"]}
    assert shares["en"] > 0.1 and shares["ru"] > 0.1
    again = {x["lang"]: x["score"] for x in one(spark, model, CORPUS["en"] * 1 + " " + (CORPUS["ru"] + " ") * 3)["distribution"]}
    assert again["ru"] > shares["ru"]


def test_only(spark, model):
    d = LanguageDetector(model).only(["fr", "en", "fr"])
    docs = spark.createDataFrame([(0, CORPUS["ru"])], "id int, text string")
    row = d.detect(docs, "id").first()
    assert {x["lang"] for x in row["distribution"]} <= {"fr", "en", "?"}
    assert d.detect_words(docs, "id").where("source = 'dict'").count() == 0
    assert d.model.order() == ["fr", "en"]
    for bad in ("xx", "?", "EN"):
        with pytest.raises(ValueError, match="supported"):
            checked([bad])
    assert LanguageDetector(model).only([]).detect(docs, "id").first()["lang"] == "?"
    assert supported_languages()[:2] == ("de", "en")


def test_detailed(spark, model):
    docs = spark.createDataFrame([(0, "the zzyzx garden"), (1, "")], "id int, text string")
    rows = {r["id"]: r for r in LanguageDetector(model).detect_detailed(docs, "id").collect()}
    assert [(w["token"], w["source"]) for w in rows[0]["words"]] == [("the", "dict"), ("zzyzx", "ngram"), ("garden", "dict")]
    assert rows[1]["words"] == [] and rows[1]["aggregate"][0]["lang"] == "?"
    assert len(rows[0]["words"][1]["scores"]) == 4 and rows[0]["words"][0]["scores"][0]["score"] == 1.0


def test_scorer_agrees_with_tables(spark, model):
    texts = [*CORPUS.values(), "zzyzx qwerty", "", None, "the garten dans"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    scorer = Scorer.of(model)
    for r in LanguageDetector(model).detect(docs, "id").collect():
        mine = scorer.detect(texts[r["id"]])
        assert (mine is None and r["lang"] is None) or (mine[0] == r["lang"] and abs(mine[1] - r["score"]) < 1e-9)


def test_save_and_load(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = Model.load(spark, str(tmp_path / "m"))
    assert again.order() == model.order()
    assert one(spark, again, CORPUS["fr"])["lang"] == "fr"
    assert again.tier(1).dictionary.where("rnk >= 1").count() == 0


def test_sql_functions(spark, model):
    from glossarion.streaming.scorer import register

    register(spark, model)
    assert spark.sql("SELECT detect_lang('the children walked').lang AS x").first()["x"] == "en"
    rows = spark.sql("SELECT w.* FROM (SELECT 'the zzyzx' AS t) d, LATERAL detect_words(d.t) w").collect()
    assert [(r["token"], r["source"]) for r in rows] == [("the", "dict"), ("zzyzx", "ngram")]


def test_only_small_models_are_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der Hund und die Katze")], "lang string, text string")
    small = train_model(docs).stored(str(tmp_path / "model"))
    words = spark.createDataFrame([("the",), ("katze",), ("zzz",)], "token string")
    hint = lambda df: "strategy=broadcast" in df._jdf.queryExecution().logical().toString()
    plain = replace(small, most_rows=MOST_SENT + 1)
    assert small.most_rows < 100 and hint(words.join(small.sent(small.dictionary), "token"))
    assert plain.sent(words) is words and replace(small, most_rows=None).sent(words) is words
    rows = lambda model: sorted((r["token"], r["source"], [round(x, 9) for x in r["s"]]) for r in word_scores(words, model).collect())
    assert rows(plain) == rows(small)
    assert train_model(docs, dict_size=MOST_SENT).most_rows > MOST_SENT
