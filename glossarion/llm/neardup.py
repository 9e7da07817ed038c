"""N-gram Jaccard join by PartEnum signatures.

A document's features are its distinct shingles of ``WORDS`` words. Sizes fall into
bands whose ends grow by 4/3, so that two sets with a Jaccard similarity of 0.75 or
more lie in one band or in neighbouring ones; a set therefore takes part in the
instance of its own band and in that of the next. For each instance the feature domain
is partitioned by hash into ``SPREAD`` times as many partitions as the band's largest
set has features, and the subsets that are enumerated are the single partitions: a
signature is the hash of a set's content in one of them. Two sets of an instance
that differ in d features differ in at most d partitions, so of the N non-empty
partitions of a set at least N - d have the same signature in the other set.

Buckets of equal signatures with up to ``SMALL`` sets give candidate pairs, at most
SMALL - 1 for each member. Larger buckets (a passage that many documents share, or a
large group of near copies) are set aside, which loses nothing for a set that keeps
more signatures than it may differ in: it still shares one of the rest with each of its
partners. Pairs that share fewer signatures than that bound demands are dropped, the
others are verified on the whole sets. Only pairs of two sets that both keep too few
signatures could be missed. Those sets go through a second join at the finest
partition, one feature each: every set is indexed by the rarest quarter (plus one) of
its features, counted among these sets, which any two similar sets must share. Each set is
compared with the smallest set that its buckets hold; buckets whose sets that has not all connected are compared exactly
in blocks of ``BLOCK`` sets, each block pair returning a spanning forest of its links rather than all of them.

Equal sets are one node from the start. Hashes of shingles and sets have 64 bits.

Defined results: null and blank texts have no shingles and link with nothing; texts of
fewer words than a shingle are one shingle; repeated rows are copies of each other; an
empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches
from .graph import components

WORDS = 5
#: Similarity as a fraction: linked where DEN * intersection >= NUM * union.
NUM, DEN = 3, 4
SPREAD = 0.4
SMALL = 16
BLOCK = 512
#: Signatures that one task holds at a time, about.
PER_PART = 3_000_000
CACHE = 400_000
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Shingler:
    """Sets of 64-bit shingle hashes; remembers the hashes of up to CACHE words."""

    def __init__(self, words: int = WORDS):
        self.n, self.known = words, {}
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(words, 0x9E3779B97F4A7C15, np.uint64))

    def hashes(self, text: str | None) -> np.ndarray:
        found = text.encode("utf-8", "replace").lower().split() if text else []
        known = self.known
        try:
            return np.array([known[w] for w in found], np.uint64)
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in found], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.hashes(text)
        if not len(w):
            return w
        n = min(self.n, len(w))
        total = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            total += w[k : len(w) - n + 1 + k] * self.powers[k]
        return np.unique(_mix(total))


def set_id(features: np.ndarray) -> int:
    """One id for equal sets, as a signed long with its lowest bit free."""
    if not len(features):
        return 0
    both = _mix(np.array([features.sum(), np.uint64(len(features))], np.uint64) + np.uint64(0x632BE59BD9B4E019))
    both[0] ^= _mix(features ^ np.uint64(0x8CB92BA72F3D8DD7)).sum()
    return int((both.sum() & ~_ONE).astype(np.int64))


def _bands(largest: int) -> np.ndarray:
    """Largest size of each band."""
    ends = [1]
    while ends[-1] < largest:
        ends.append((ends[-1] + 1) * DEN // NUM)
    return np.array(ends)


_ENDS = _bands(1 << 40)


def instances(n: int) -> list[tuple[int, int, int]]:
    """(instance, its number of partitions, most differences to a partner in it) of a set of size n."""
    own = int(np.searchsorted(_ENDS, n))
    out = []
    for j in (own, own + 1):
        end = int(_ENDS[j])
        cells = 4 * end if end < 64 else int(np.ceil(SPREAD * end))
        partner = min(end, n * DEN // NUM)
        out.append((j, cells, (n + partner) * (DEN - NUM) // (DEN + NUM)))
    return out


def signatures(features: np.ndarray, instance: int, cells: int) -> np.ndarray:
    """A hash of the content of each non-empty partition."""
    with np.errstate(over="ignore"):
        cell = _mix(features + np.uint64((instance * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)) % np.uint64(cells)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        content = np.add.reduceat(_mix(features[order] ^ np.uint64(0xA0761D6478BD642F)), first)
        return _mix(content ^ _mix(cell[first] * np.uint64(1 << 20) + np.uint64(instance)))


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n, node, and for both instances how many signatures a set has beyond its differences."""
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].cast("string").alias("text")
    )
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                s = shingle(text)
                spare = [len(signatures(s, j, cells)) - k for j, cells, k in instances(len(s))] if len(s) else [1, 1]
                rows.append((len(s), set_id(s), *spare))
            n, node, own, following = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "text_hash": batch.column(1), "n": n, "node": node, "spare0": own, "spare1": following}
            )

    return picked.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, node long, spare0 long, spare1 long")


def _emit(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            sigs, nodes, done = [], [], set()
            for text in batch.column(0).to_pylist():
                s = shingle(text)
                node = set_id(s)
                if not len(s) or node in done:
                    continue
                done.add(node)
                for role, (j, cells, _) in enumerate(instances(len(s))):
                    sigs.append(signatures(s, j, cells))
                    nodes.append(np.full(len(sigs[-1]), node + role, np.int64))
            if not sigs:
                continue
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            part = (sig % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, sig, node = part[order], sig[order], node[order]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = [*at[1:], len(part)]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": part[at],
                    "sigs": pa.array([sig[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                    "nodes": pa.array([node[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                }
            )

    return run


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort([b, a])
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
    return a[first], b[first], np.diff(np.append(first, len(a)))


def _bucket(table: pa.Table) -> pa.Table:
    """Rows (a, b, n): a pair and how many small buckets it shares; or a, 0 and how many large ones a is in."""
    joined = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()])
    sig, node, _ = _unique_pairs(joined("sigs", np.uint64), joined("nodes", np.int64))
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, SMALL + 1):
        at = first[size == m]
        if len(at):
            members = node[at[:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            left.append(members[:, i].ravel())
            right.append(members[:, j].ravel())
    a, b, n = _unique_pairs(np.concatenate(left), np.concatenate(right))
    keep = a >> 1 != b >> 1
    crowded, times = np.unique(node[np.repeat(size > SMALL, size)], return_counts=True)
    return pa.table(
        {
            "a": np.concatenate([a[keep], crowded]),
            "b": pa.array(np.concatenate([b[keep], np.zeros(len(crowded), np.int64)]), mask=np.arange(keep.sum() + len(crowded)) >= keep.sum()),
            "n": np.concatenate([n[keep], times]).astype(np.int64),
        }
    )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        sets = [shingle(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "node": np.array([set_id(s) for s in sets], np.int64),
                "features": pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())),
            }
        )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fa, fb = batch.column(2), batch.column(3)
        ok = [similar(fa[i].values.to_numpy(), fb[i].values.to_numpy()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _forest(node: np.ndarray, links: np.ndarray) -> tuple[list[int], list[int]]:
    parent = list(range(len(node)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = [], []
    for i, j in links:
        ri, rj = root(i), root(j)
        if ri != rj:
            parent[ri] = rj
            a.append(int(node[i]))
            b.append(int(node[j]))
    return a, b


def _compare_block(table: pa.Table) -> pa.Table:
    """A spanning forest of the links among the sets of one pair of blocks."""
    node = table["node"].to_numpy()
    sets = [x.values.to_numpy() for x in table["features"]]
    size = np.array([len(s) for s in sets])
    feature, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    start = np.concatenate([[True], feature[1:] != feature[:-1]])
    column = np.cumsum(start) - 1
    shared = np.bincount(column) > 1
    renumbered = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = renumbered[column[keep]], owner[keep]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        both += dense @ dense.T
    both = both.astype(np.int64)
    linked = np.triu(DEN * both >= NUM * (size[:, None] + size[None] - both), 1)
    a, b = _forest(node, np.argwhere(linked))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dense_links(sets: DataFrame) -> DataFrame:
    """a, b: enough links among the given sets (node, features) to connect what is similar."""
    each = sets.select("node", F.size("features").alias("size"), F.explode("features").alias("f"))
    often = each.groupBy("f").agg(F.count("*").alias("df"))
    ranked = (
        each.join(often.withColumnRenamed("f", "g"), F.col("f") == F.col("g"))
        .groupBy("node", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "f"))).alias("fs"))
    )
    length = F.col("size") - F.ceil(F.col("size") * NUM / DEN).cast("int") + 1
    rarest = cut(ranked.select("node", F.explode(F.slice("fs", F.lit(1), length)).alias("x")).select("node", F.col("x.f").alias("f")))
    centre = rarest.groupBy("f").agg(F.min("node").alias("centre"), F.count("*").alias("m")).where("m > 1")
    near = cut(rarest.join(centre.withColumnRenamed("f", "g"), F.col("f") == F.col("g")).select("f", F.col("centre").alias("a"), F.col("node").alias("b")))
    # First each set with the smallest set of all its buckets, one pair a set; what that connects needs no more comparing.
    side = lambda c: sets.select(F.col("node").alias(c), F.col("features").alias(f"f{c}"))
    star = near.groupBy("b").agg(F.min("a").alias("a")).where("a <> b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb")
    linked = cut(star.mapInArrow(_verify, "a long, b long"))
    found = components(linked)
    of = found.select(F.col("node").alias("n"), "component")
    marked = near.join(of, F.col("b") == F.col("n"), "left").withColumn("component", F.coalesce("component", "b"))
    open_ = marked.groupBy("f").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(F.col("f").alias("open"))
    near = near.join(open_, F.col("f") == F.col("open"), "left_semi").select("a", "b")
    groups = components(near.where("a <> b"))
    sized = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(sized.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).select(
        F.col("node").alias("member"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    )
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "member", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    whole = spread.join(sets, spread["member"] == sets["node"]).select("component", "i", "j", "node", "features")
    return linked.unionByName(whole.groupBy("component", "i", "j").applyInArrow(_compare_block, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) for every row, and
    beside them text_hash and representative: whether no row of the group is before it."""
    spark = docs.sparkSession
    small_batches(spark)
    described = cut(describe(docs, id_col, text_col))
    nodes = cut(
        described.where("n > 0").groupBy("node").agg(
            F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("spare0").alias("spare0"), F.first("spare1").alias("spare1")
        )
    )
    total = nodes.agg(F.sum("n")).first()[0] or 0
    n_parts = max(partitions(spark), total // PER_PART + 1)
    emitted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(_emit(n_parts), "part long, sigs binary, nodes binary")
    buckets = cut(emitted.groupBy("part").applyInArrow(_bucket, "a long, b long, n long"))
    # How many signatures outside large buckets a set has beyond its differences, by instance.
    crowded = buckets.where("b IS NULL").groupBy(F.col("a").alias("sided")).agg(F.sum("n").alias("crowded"))
    sides = nodes.select("node", F.explode(F.array(*[
        F.struct((F.col("node") + r).alias("sided"), F.col(f"spare{r}").alias("spare")) for r in (0, 1)
    ])).alias("s")).select("node", "s.*")
    left = cut(
        sides.join(crowded.withColumnRenamed("sided", "of"), F.col("sided") == F.col("of"), "left").select(
            "node", "sided", (F.col("spare") - F.coalesce("crowded", F.lit(0))).alias("least")
        )
    )
    pairs = buckets.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    bound = lambda c: left.select(F.col("sided").alias(c), F.col("least").alias(f"least_{c}"))
    kept = (
        pairs.join(bound("a"), "a").join(bound("b"), "b")
        .where("shared >= least_a AND shared >= least_b")
        .select(*[(F.col(c) - F.pmod(F.col(c), F.lit(2))).alias(c) for c in ("a", "b")])
        .distinct()
    )
    kept = cut(kept)
    few = cut(left.where("least <= 0").select("node").distinct())
    wanted = kept.select(F.col("a").alias("node")).unionByName(kept.select(F.col("b").alias("node"))).unionByName(few).distinct()
    hashes = wanted.join(nodes, "node").select(F.col("text_hash").alias("wanted_hash")).distinct()
    texts = docs.select(F.xxhash64(docs[text_col]).alias("h"), docs[text_col].cast("string").alias("text"))
    sets = cut(
        texts.join(hashes, F.col("h") == F.col("wanted_hash"), "left_semi")
        .dropDuplicates(["h"]).select("text")
        .mapInArrow(_whole_sets, "node long, features array<long>").dropDuplicates(["node"])
    )
    side = lambda c: sets.select(F.col("node").alias(c), F.col("features").alias(f"f{c}"))
    both = kept.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb")
    links = both.mapInArrow(_verify, "a long, b long").unionByName(_dense_links(sets.join(few, "node", "left_semi")))
    found = components(links)
    classes = described.join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        "doc_id", "text_hash", "n", F.coalesce("component", "node").alias("class")
    )
    row = F.struct("doc_id", "text_hash")
    first = classes.groupBy("class").agg(F.min("doc_id").alias("least"), F.min(row).alias("first"))
    return classes.join(first.withColumnRenamed("class", "of"), F.col("class") == F.col("of")).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_hash",
        ((F.col("n") == 0) | (row == F.col("first"))).alias("representative"),
    )
