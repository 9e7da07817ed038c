"""Readers of frequency lists, corpora, models and fixtures. Paths are files or folders that Spark opens."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.langs import FLORES, ISO3
from ..functions.ship import ship
from ..functions.text import tokens


def frequency_list(spark: SparkSession, path: str, lang: str, top_n: int | None = None) -> DataFrame:
    """lang, line, token, freq from lines ``word freq``; malformed lines, and words without a letter, are skipped.

    Of words that are equal once normalised the first line counts."""
    numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = numbered.select(
        "line", F.get(tokens(F.get(parts, F.lit(0))), F.lit(0)).alias("token"), F.get(parts, F.lit(1)).try_cast("bigint").alias("freq"), F.size(parts).alias("n"),
    ).where("token IS NOT NULL AND freq IS NOT NULL AND n >= 2")
    firsts = rows.groupBy("token").agg(F.min("line").alias("line"), F.min_by("freq", "line").alias("freq"))
    out = firsts.select(F.lit(lang).alias("lang"), "line", "token", "freq")
    return out.orderBy("line").limit(top_n) if top_n else out


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """member, line (from 0), value: the lines of the text files in tar archives, packed or not. One task reads an archive.

    ``tar_sentences`` and ``tar_split`` make tables of them."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for member in archive:
                        if member.isfile():
                            lines = archive.extractfile(member).read().decode("utf-8", "replace").splitlines()
                            for low in range(0, len(lines), 10_000):
                                part = lines[low : low + 10_000]
                                columns = [pa.array([member.name] * len(part)), pa.array(range(low, low + len(part)), pa.int64()), pa.array(part, pa.string())]
                                yield pa.RecordBatch.from_arrays(columns, ["member", "line", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, line long, value string")


def tar_sentences(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """lang, id, sentence from the member ``*-sentences.txt`` of an archive."""
    rows = archive_lines(spark, path).where(F.col("member").endswith("-sentences.txt"))
    parts = F.split("value", "\t", 2)
    found = rows.select(F.lit(lang).alias("lang"), F.get(parts, F.lit(0)).try_cast("bigint").alias("id"), F.trim(F.get(parts, F.lit(1))).alias("sentence"))
    return found.where("sentence IS NOT NULL AND sentence <> ''")


def tar_split(spark: SparkSession, path: str, split: str = "devtest", langs: tuple[str, ...] = tuple(FLORES)) -> DataFrame:
    """lang, line, text from the members ``<code>.<split>`` of an archive; a missing language is an error."""
    names = F.create_map(*[F.lit(x) for k in langs for x in (f"{FLORES[k]}.{split}", k)])
    file = F.element_at(F.split("member", "/"), -1)
    rows = archive_lines(spark, path).select(names[file].alias("lang"), "line", F.trim("value").alias("text")).where("lang IS NOT NULL AND text <> ''")
    there = {r["lang"] for r in rows.select("lang").distinct().collect()}
    if lacking := [x for x in langs if x not in there]:
        raise ValueError(f"the archive has no {split} of {', '.join(lacking)}")
    return rows


def sentence_pairs(spark: SparkSession, path: str, low: int = 20, high: int = 200) -> DataFrame:
    """id, lang, text from lines ``id TAB iso3 TAB text``, bz2 too, for texts of low to high code points."""
    raw = spark.read.csv(path, sep="\t", quote="", schema="id string, iso3 string, text string")
    names = F.create_map(*[F.lit(x) for k, v in ISO3.items() for x in (v, k)])
    rows = raw.select("id", names[F.col("iso3")].alias("lang"), F.trim("text").alias("text"))
    return rows.where(F.col("lang").isNotNull() & F.length("text").between(low, high))


def split_corpus(spark: SparkSession, folder: str, split: str = "devtest", langs: tuple[str, ...] = tuple(FLORES)) -> DataFrame:
    """lang, text from an unpacked folder of files ``<split>/<code>.<split>``; a missing language is an error."""
    paths = {f"{FLORES[x]}.{split}": x for x in langs}
    raw = spark.read.text([f"{folder}/{split}/{name}" for name in paths])
    names = F.create_map(*[F.lit(x) for k, v in paths.items() for x in (k, v)])
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return raw.select(names[file].alias("lang"), F.trim("value").alias("text")).where("text <> ''")


def numbered_sentences(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """lang, id, sentence from lines ``id TAB sentence``."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(F.lit(lang).alias("lang"), F.get(parts, F.lit(0)).try_cast("bigint").alias("id"), F.trim(F.get(parts, F.lit(1))).alias("sentence"))
    return rows.where("sentence IS NOT NULL AND sentence <> ''")


def word_list(spark: SparkSession, path: str, lang: str, dict_size: int = 3000) -> DataFrame:
    """token, lang, rnk: the line number is the rank; a blank line is no word but takes one."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("rnk", "value"))
    rows = lines.where(F.col("rnk") < dict_size).select(F.trim("value").alias("token"), F.lit(lang).alias("lang"), "rnk")
    return rows.where("token <> ''")


def trigram_list(spark: SparkSession, path: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """(lang, tri, lp) and (lang, lp) of the FLOOR line; malformed lines are skipped, a missing file is an error."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.lit(lang).alias("lang"), F.get(parts, F.lit(0)).alias("tri"), F.get(parts, F.lit(1)).try_cast("double").alias("lp"))
    good = rows.where("lp IS NOT NULL")
    return good.where("tri <> 'FLOOR'"), good.where("tri = 'FLOOR'").select("lang", "lp")


def labelled_tsv(spark: SparkSession, path: str) -> DataFrame:
    """lang, text from lines ``iso TAB sentence``; blank lines, comments and malformed lines are skipped."""
    line = F.trim("value")
    parts = F.split(line, "\t", 2)
    rows = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("\t")))
    return rows.select(F.get(parts, F.lit(0)).alias("lang"), F.get(parts, F.lit(1)).alias("text"))


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """pos, text from a JSON array of strings, or else one text a line without quotes and commas."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "array<string>", {"mode": "PERMISSIVE"})
    plain = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.btrim(x, F.lit('", \t\r'))), lambda x: x != "")
    valid = F.startswith(F.trim("value"), F.lit("[")) & parsed.isNotNull()
    return whole.select(F.posexplode(F.when(valid, parsed).otherwise(plain)).alias("pos", "text"))


def inline_text(spark: SparkSession, *texts: str) -> DataFrame:
    """pos, text"""
    return spark.createDataFrame(list(enumerate(texts)), "pos int, text string")
