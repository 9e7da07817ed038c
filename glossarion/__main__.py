"""python -m glossarion train | detect | accuracy | sample: see --help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .functions.langs import supported_languages
from .nouns import detect_detailed_text
from .operators import evaluate, sample
from .operators.detect import LanguageDetector
from .operators.train import Model, train_model
from .sources import readers, writers


def _labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else readers.labelled_tsv(spark, path)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glossarion")
    commands = top.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train", help="train a model from labelled texts (Parquet with lang and text, or lang TAB text)")
    train.add_argument("texts")
    train.add_argument("model")
    train.add_argument("--dict-size", type=int, default=3000)
    train.add_argument("--lists", help="write words and trigrams as text files there too")
    detect = commands.add_parser("detect", help="the language of a text, or of standard input: top, distribution, words")
    detect.add_argument("model")
    detect.add_argument("text", nargs="*")
    detect.add_argument("--only", nargs="+", choices=supported_languages())
    detect.add_argument("--unknown-threshold", type=float, default=None)
    accuracy = commands.add_parser("accuracy", help="accuracy of a model on labelled texts, as Markdown")
    accuracy.add_argument("model")
    accuracy.add_argument("texts")
    picked = commands.add_parser("sample", help="the same number of texts of each language, as lang TAB text")
    picked.add_argument("texts")
    picked.add_argument("out")
    picked.add_argument("--per-lang", type=int, default=500)
    picked.add_argument("--seed", type=int, default=sample.SEED)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """What the command has to say, which is printed by ``python -m``."""
    a = arguments().parse_args(args)
    spark = spark or SparkSession.builder.appName("glossarion").getOrCreate()
    if a.command == "train":
        model = train_model(_labelled(spark, a.texts), dict_size=a.dict_size).stored(a.model)
        if a.lists:
            writers.words(model.dictionary, f"{a.lists}/words", a.dict_size)
            writers.trigrams(model.trigrams, model.floors, f"{a.lists}/trigrams")
        return f"{len(model.order())} languages in {a.model}"
    if a.command == "sample":
        docs = _labelled(spark, a.texts)
        keyed = docs if "doc_id" in docs.columns else sample.keyed(docs)
        rows = sample.sample_per_language(keyed, a.per_lang, seed=a.seed).join(keyed.select("doc_id", "text"), "doc_id")
        writers.evaluation_tsv(rows, a.out)
        return a.out
    detector = LanguageDetector.supporting(Model.load(spark, a.model))
    if a.command == "detect":
        detector = detector.only(a.only) if a.only else detector
        detector = detector if a.unknown_threshold is None else detector.unknown_threshold(a.unknown_threshold)
        found = detect_detailed_text(detector, " ".join(a.text) or sys.stdin.read())
        listed = lambda x: "  ".join(f"{lang} {score:.3f}" for lang, score in x)
        return "\n".join([found.aggregate[0][0], listed(found.aggregate), *(f"{w.token}\t{w.source}\t{listed(w.scores)}" for w in found.words)])
    texts = _labelled(spark, a.texts).withColumnRenamed("lang", "expected")
    return evaluate.report(detector.detect(texts, "expected").withColumnRenamed("lang", "predicted"))


if __name__ == "__main__":
    print(main())
