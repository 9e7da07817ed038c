"""Writers of word lists, trigram lists, evaluation files and JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.langs import LANGS
from ..functions.text import clean_tsv


def words(dictionary: DataFrame, path: str, dict_size: int = 10_000) -> None:
    """A text file a language, a word a line in the order of ranks."""
    rows = dictionary.where(F.col("rnk") < dict_size).repartition("lang").sortWithinPartitions("lang", "rnk")
    rows.select("lang", F.col("token").alias("value")).write.mode("overwrite").partitionBy("lang").text(path)


def trigrams(model: DataFrame, floors: DataFrame, path: str) -> None:
    """A text file a language: FLOOR first, then the trigrams in order, with log-probabilities."""
    head = floors.select("lang", F.lit(0).alias("k"), F.lit("FLOOR").alias("tri"), "lp")
    rows = head.unionByName(model.select("lang", F.lit(1).alias("k"), "tri", "lp")).repartition("lang").sortWithinPartitions("lang", "k", "tri")
    line = F.concat_ws("\t", "tri", F.col("lp").cast("string"))
    rows.select("lang", line.alias("value")).write.mode("overwrite").partitionBy("lang").text(path)


def evaluation_tsv(rows: DataFrame, path: str, comment: str = "lang TAB text", langs: tuple[str, ...] = LANGS) -> None:
    """Lines ``iso TAB text`` under a comment, in files whose names follow the order of the languages asked for;
    tabs and line ends in texts become blanks. Rows are dealt by ranges, so a file is a task's share."""
    places = F.create_map(*[F.lit(x) for k, v in enumerate(langs) for x in (v, k)])
    head = rows.sparkSession.createDataFrame([(-1, f"# {comment}")], "place int, value string")
    lines = rows.select(F.coalesce(places[F.col("lang")], F.lit(len(langs))).alias("place"), F.concat_ws("\t", "lang", clean_tsv(F.col("text"))).alias("value"))
    head.unionByName(lines).orderBy("place").select("value").write.mode("overwrite").text(path)


def json_array(rows: DataFrame, path: str, pos: str = "pos", text: str = "text") -> None:
    """One JSON array of strings; for fixtures, which one task can hold."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(pos, text))), lambda x: x[text])
    rows.agg(F.to_json(ordered).alias("value")).write.mode("overwrite").text(path)
