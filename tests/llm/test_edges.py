"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

import corpus_pipeline
import pytest
from glossarion.llm import q01_chat, q02_lm, q03_neardup, q04_pii, q05_media, q06_quality, q07_mixing, q08_lines, q09_toxicity, q10_bpe
from glossarion.llm.chat import format_chats, read_back
from pyspark.sql import functions as F

LONG = " ".join(f"w{k % 997}" for k in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 44, 5), (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 44, 5),
    (2, None, "en", "a", None, 5), (3, "", None, None, 0, 5), (4, " \n\t ", "en", "b", 4, 5), (5, LONG, "de", "b", len(LONG), None),
    (None, "one two three four five six", None, None, 27, 1), (6, "alpha beta gamma delta epsilon zeta eta theta", "en", None, 44, 1),
    (7, "x" * 30_000, "en", "a", 30_000, 1), (8, "same\nsame\nother line here", "fr", "a", 24, 2), (8, "a different text, the same id", "fr", "a", 29, 2),
]
CLASH = ("score", "size", "n_words", "word", "bits", "h", "pos", "node", "block", "component", "n_removed", "copies", "features", "lines")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, x int")
    docs = docs.select(*docs.columns[:-1], *[F.col("x").alias(c) for c in CLASH])
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(1, 1, 0), (5, 0, 1), (6, None, None), (8, 1, 0), (8, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    turns = [(1, 0, "user", None, 1), (1, 1, None, "x", 1), (1, 1, None, "x", 1), (None, None, "assistant", "</turn>\\", 2), (2, 0, "a: b", "### <|chat \\", 3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chars int").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


QUERIES = [
    q02_lm.op2_lm_scoring, q03_neardup.op3_ngram_jaccard, q04_pii.op4_personal_data, q05_media.op5_gif_media, q06_quality.op6_quality_rules,
    q07_mixing.op7_mixing, q09_toxicity.op9_toxicity, q10_bpe.op10_bpe,
]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_every_row_has_a_result(spark, folder, query):
    found = query(spark, folder)
    assert len(set(found.columns)) == len(found.columns)
    ids = sorted(str(r["doc_id"]) for r in found.collect())
    assert ids == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("query", [*QUERIES, q08_lines.op8_line_dedup], ids=lambda q: q.__name__)
def test_empty_tables(spark, empty, query):
    assert query(spark, empty).count() == 0


def test_lines_of_odd_rows(spark, folder):
    rows = q08_lines.op8_line_dedup(spark, folder).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[8]) == 2 and sorted(r["n_removed"] for r in by[8]) == [0, 1]
    assert by[2][0]["text_sha256"] is None and by[2][0]["n_removed"] == 0
    assert by[6][0]["n_removed"] == 1 and [r["n_removed"] for r in by[3]] == [0]
    assert len(rows) == len(ROWS) - 1  # the repeated row is one document


def test_groups_of_odd_rows(spark, folder):
    rows = q03_neardup.op3_ngram_jaccard(spark, folder).collect()
    assert {(r["component_id"], r["n_shingles"]) for r in rows if r["doc_id"] in (1, 6)} == {(1, 4)}
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["n_shingles"] == 0} == {(2, 2), (3, 3), (4, 4)}


def test_chats_of_odd_rows(spark, folder, empty):
    rows = q01_chat.op1_chat_formatting(spark, folder).collect()
    assert all(r["round_trip"] for r in rows) and {r["conv_id"] for r in rows} == {1, 2, None, -7}
    assert {r["conv_id"]: r["escape_level"] for r in rows} == {1: 0, 2: 2, None: 2, -7: 1}
    assert [r["conv_id"] for r in q01_chat.op1_chat_formatting(spark, empty).collect()] == [-7]


@pytest.mark.parametrize("text", ["\\</turn>", "\\\\### ", "ends \\", "### ", ": </turn>\n### user: x</turn>\n", "<|chat|>", "\n", "\\l\\b", "é😀</turn>"])
def test_chat_round_trip(spark, text):
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id int, turn int, role string, text string")
    row = read_back(format_chats(turns)).first()
    assert row["round_trip"] and row["loss_text"] == text


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, folder, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = stage(spark, docs, folder)
    if k < 4:
        assert found.columns == docs.columns
    ids = {r["doc_id"] for r in found.collect()}
    assert ids <= {r[0] for r in ROWS} and (k == 3 or {2, 3, 4, None} <= ids)
    assert stage(spark, docs.limit(0), empty).count() == 0
