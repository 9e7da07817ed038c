"""Detection as SQL functions and over streams, which need no state as a row is scored by itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..operators.scorer import Scorer
from ..operators.train import Model


def detect_stream(docs: DataFrame, model: Model | Scorer, text: str = "text") -> DataFrame:
    """The rows, streaming or not, with ``lang`` and ``score`` of their text put in place of such columns."""
    ship(docs.sparkSession)
    scorer = model if isinstance(model, Scorer) else Scorer.of(model)
    others = [c for c in docs.columns if c not in ("lang", "score")]
    picked = docs.select(*others)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = scorer.live()
        for batch in batches:
            langs, scores = live.best(batch.column(others.index(text)).to_pylist())
            columns = dict(zip(others, batch.columns, strict=True))
            yield pa.RecordBatch.from_pydict({**columns, "lang": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return picked.mapInArrow(run, f"{fields}, lang string, score double")


def register(spark: SparkSession, model: Model | Scorer) -> None:
    """``detect_lang(text)`` and, for LATERAL, ``detect_words(text)`` in SQL."""
    ship(spark)
    scorer = model if isinstance(model, Scorer) else Scorer.of(model)

    @F.pandas_udf("struct<lang: string, score: double>")
    def detect_lang(texts: pd.Series) -> pd.DataFrame:
        langs, scores = scorer.live().best(list(texts))
        return pd.DataFrame({"lang": langs, "score": scores})

    class Words:
        def eval(self, text: str | None):
            for token in scorer.tokens(text or ""):
                source, scores = scorer.word(token)
                best = max(range(len(scores)), key=lambda k: (scores[k], -k))
                yield token, source, scorer.langs[best], scores[best]

    spark.udf.register("detect_lang", detect_lang)
    spark.udtf.register("detect_words", F.udtf(Words, returnType="token: string, source: string, lang: string, score: double"))
