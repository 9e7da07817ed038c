"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times, and
one time more for the documents of a balanced sample with inclusion probability
r - floor(r). The flight phase moves those probabilities along the null space of the
two constraints (documents and tokens of the source), three documents at a time,
until each is 0 or 1, so that both totals stay what they were. It runs in blocks of
about ``BLOCK`` documents of one source; at most two documents of a block stay
undecided and meet in blocks of the next level, and so on, until each source is one
block. The last block keeps POOL documents out of the flight; with the at most two that it
leaves they are the landing problem, ended in the way that comes nearest to both totals. No decision of
the flight is reversed.

Only (id, source, size) rows move, a hot source is many blocks, and a level is a
four-thousandth of the one before. Blocks follow a hash of the id and random steps
are seeded by source, level and block, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; repeated rows and ties are units of their own; an empty table gives no rows;
other input columns are ignored.
"""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, small_batches

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 4096
#: Documents of a source's last block that the flight leaves to the landing.
POOL = 12
_EPS = 1e-9


def targets(units: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target: the shares of each source, a row for each."""
    sizes = units.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS)).cast("int"))
    weighed = sizes.withColumn("w", weight).withColumn("full_at", MOST * F.col("source_size") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # Sources fill up in order of full_at; from the first that does not, the rest share by weight.
    level = (
        SHARE * F.sum("source_size").over(everything)
        - F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0))
    ) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)
    final = first["level"]
    most = MOST * F.col("source_size").cast("double")
    return levels.select(
        "source", "n_docs", "source_size",
        F.coalesce(F.least(most, final * F.col("w")), most).alias("target"),
    )


def flight(pi: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Probabilities with the same totals, sum(pi) and sum(pi * size), of which at most two are not 0 or 1."""
    pi = list(pi)
    active: list[int] = []
    for k, p in enumerate(pi):
        if not _EPS < p < 1 - _EPS:
            pi[k] = float(round(p))
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1, -1, 0)
        up = down = float("inf")
        for i, d in zip(active, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - pi[i]) / d), min(down, pi[i] / d)
            elif d < 0:
                up, down = min(up, pi[i] / -d), min(down, (1 - pi[i]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(active, u, strict=True):
            pi[i] += step * d
            if pi[i] <= _EPS or pi[i] >= 1 - _EPS:
                pi[i] = 0.0 if pi[i] < 0.5 else 1.0
        active = [i for i in active if 0 < pi[i] < 1]
    return pi


def landing(pi: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Ends the few probabilities that are left, at most 2 + POOL, by the cost of both totals.

    Of all ways to end them, the one with the least sum of squared misses, of the token total and (counting a
    hundredth) of the document total, each in proportion to the whole; equal ones are drawn from."""
    left = [k for k, p in enumerate(pi) if 0 < p < 1]
    if not left:
        return pi
    ways = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    p, n = np.array([pi[k] for k in left]), np.array([size[k] for k in left], float)
    tokens = max(1.0, sum(x * s for x, s in zip(pi, size, strict=True)))
    cost = ((ways - p) @ n / tokens) ** 2 + (0.01 * (ways - p).sum(1) / max(1.0, sum(pi))) ** 2
    least = np.flatnonzero(cost <= cost.min() + 1e-15)
    out = list(pi)
    for x, k in zip(ways[least[rng.randrange(len(least))]], left, strict=True):
        out[k] = float(x)
    return out


def _settle(level: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table["size"].to_numpy(), table["h"].to_numpy()])
        table = table.take(pa.array(order))
        source, block, last = (table[c][0].as_py() for c in ("source", "block", "last"))
        rng = random.Random(crc32(repr((source, block, level)).encode()))
        pi, size = table["pi"].to_pylist(), table["size"].to_pylist()
        if last:  # some are kept out of the flight for the landing
            pool = [k for k, p in enumerate(pi) if _EPS < p < 1 - _EPS][:POOL]
            fly = sorted(set(range(len(pi))) - set(pool))
            moved = list(pi)
            for k, p in zip(fly, flight([pi[k] for k in fly], [size[k] for k in fly], rng), strict=True):
                moved[k] = p
            moved = landing(moved, size, rng)
        else:
            moved = flight(pi, size, rng)
        return table.set_column(table.schema.get_field_index("pi"), "pi", pa.array(moved, pa.float64()))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *keys: str) -> DataFrame:
    """doc_id, [keys], size, source, source_size, target, copies (0 to 2), a row for each document."""
    small_batches(docs.sparkSession)
    size = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")
    units = cut(docs.select(F.col(id_col).alias("doc_id"), *keys, docs[source_col].alias("source"), size.alias("size")))
    goals = cut(targets(units)).select(F.col("source").alias("of"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = (
        units.join(goals, F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("base", F.floor(ratio).cast("int"))
        .withColumn("pi", ratio - F.floor(ratio))
        .withColumn("h", F.xxhash64("doc_id", *keys))
        .drop("of")
    )
    columns = state.columns
    settled, level = None, 0
    while True:
        counts = state.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
        blocks = state.join(counts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        blocked = blocks.select(
            *columns,
            F.pmod(F.xxhash64("h", F.lit(level)), F.col("n_blocks")).alias("block"),
            (F.col("n_blocks") == 1).alias("last"),
        )
        schema = ", ".join(f"`{n}` {t}" for n, t in blocked.dtypes)
        moved = cut(blocked.groupBy("source", "block").applyInArrow(_settle(level), schema)).select(*columns)
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        done, state = moved.where(~open_), moved.where(open_)
        settled = done if settled is None else settled.unionByName(done)
        level += 1
        if state.isEmpty():
            break
    return settled.select(
        "doc_id", *keys, "source", "size", "source_size", "target", (F.col("base") + F.col("pi").cast("int")).alias("copies")
    )
