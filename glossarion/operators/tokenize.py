"""Documents to tokens, term frequencies and vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import tokens as split
from ..functions.ship import ship
from ..functions.text import tokens


#: Bytes of input for each core up to which rows are dealt out anew.
SPREAD_BYTES = 16 << 20


def spread(docs: DataFrame) -> DataFrame:
    """A small table, which may be one row group and so one task, dealt to all cores; a large one as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    plan = getattr(docs, "_jdf", None)  # a remote session has no such handle, and no need of this
    if plan is None:
        return docs
    size = plan.queryExecution().optimizedPlan().stats().sizeInBytes()
    return docs.repartition(cores) if int(str(size)) < SPREAD_BYTES * cores else docs


def word_tokens(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, pos, token: a row for each token."""
    return docs.select(*keys, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def term_frequencies(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, token, n. Tokens are counted where they are read, before the shuffle."""
    exploded = docs.select(*keys, F.explode(tokens(F.col(text))).alias("token"))
    return exploded.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def strict_tokens(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, pos, token by Unicode word boundaries, NFKC and per-character lower case.

    For exact boundaries outside ASCII (host names, underscores, abbreviations); the
    boundary rules are not expressible in Spark's regular expressions, so Arrow
    batches go through Python."""
    ship(docs.sparkSession)
    picked = docs.select(*keys, F.col(text).alias("text__"))
    fields = [f for f in picked.schema.fields if f.name != "text__"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [split(x, "strict") for x in batch.pop("text__")]
            long = batch.loc[batch.index.repeat([len(x) for x in found])].reset_index(drop=True)
            long["pos"] = pd.Series([k for x in found for k in range(len(x))], dtype="int32")
            long["token"] = pd.Series([t for x in found for t in x], dtype=object)
            yield long

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return picked.mapInPandas(run, schema + "pos int, token string")
