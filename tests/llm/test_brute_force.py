"""Operators that SQL cannot express against plain versions of themselves."""

import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from glossarion.llm import bpe, gif, lines, lm, mixing, neardup, pii, toxicity
from glossarion.llm.common import documents
from glossarion.llm.q04_pii import op4_personal_data
from glossarion.llm.q05_media import op5_gif_media
from glossarion.llm.q07_mixing import op7_mixing
from glossarion.llm.q09_toxicity import op9_toxicity
from glossarion.llm.q10_bpe import VOCABULARY, op10_bpe
from hypothesis import given, settings
from hypothesis import strategies as st
from ..conftest import SF

SF2 = "/root/testdata/sf0.01"


def words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def plain_groups(rows):
    """doc_id: (size, smallest id) by comparing every pair that shares a shingle."""
    sets = []
    for _, t in rows:
        w = words(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    having = {}
    for i, s in enumerate(sets):
        for g in s:
            having.setdefault(g, []).append(i)
    pairs = {(i, j) for m in having.values() for i in m for j in m if i < j}
    links = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    rank = {i: k for k, i in enumerate(order)}
    group = roots(len(rows), [(rank[i], rank[j]) for i, j in links])
    return {rows[i][0]: (len(sets[i]), rows[order[group[rank[i]]]][0]) for i in range(len(rows))}


def variants(seed, n_bases, n_copies, length):
    """Groups of copies with a few words changed, and a passage that every text shares."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(n_bases):
        base = [word() for _ in range(rng.randint(3, length))] + passage
        for _ in range(n_copies):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("rows", [variants(1, 12, 8, 120), variants(2, 2, 60, 90), variants(3, 60, 2, 6)], ids=["small", "large groups", "short"])
def test_near_duplicates(spark, rows):
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == plain_groups(rows)


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    """Crowded sets of one component in many more than two blocks, and a passage that dissimilar texts share."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(9)
    rows = variants(4, 3, 40, 60)
    passage = " ".join(rng.choice("klmnop") + str(rng.randint(0, 99)) for _ in range(40))
    rows += [(1000 + i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(rng.choice((4, 9, 30))))) for i in range(40)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == plain_groups(rows)


def test_near_duplicates_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    found = neardup.near_duplicates(documents(spark, SF))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == plain_groups(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**62), min_size=1, max_size=60), st.data())
def test_similar_sets_share_enough_signatures(a, data):
    """Sets that differ in d features share N - d signatures in a common instance."""
    a = sorted(a)
    b = sorted((set(a) - set(data.draw(st.lists(st.sampled_from(a), max_size=len(a) // 8)))) | data.draw(st.sets(st.integers(0, 2**62), max_size=len(a) // 9)))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    if not neardup.similar(x, y):
        return
    differ, shared = len(set(a) ^ set(b)), {j for j, _, _ in neardup.instances(len(x))} & {j for j, _, _ in neardup.instances(len(y))}
    assert shared
    for (j, cells, most) in neardup.instances(len(x)):
        if j in shared:
            p, q = (set(neardup.signatures(s, j, cells).tolist()) for s in (x, y))
            assert differ <= most and len(p & q) >= len(p) - differ


def plain_lines(rows):
    """doc_id: text after fuzzy deduplication."""
    split = lambda x: tuple(w for w in regex.split(r"[^\p{L}\p{N}]+", x.lower()) if w)
    place = {}
    for d, t in sorted(rows):
        for i, x in enumerate(t.split("\n")):
            if split(x):
                place.setdefault(split(x), (d, i))
    keys = list(place)
    every = pd.DataFrame([(i, " ".join(k)) for i, k in enumerate(keys)], columns=["i", "x"])  # noqa: F841
    links = duckdb.sql(
        "SELECT a.i, b.i FROM every a JOIN every b ON a.i > b.i AND length(a.x) >= 0.9 * length(b.x) AND length(b.x) >= 0.9 * length(a.x) "
        "WHERE levenshtein(a.x, b.x) <= floor(0.1 * greatest(length(a.x), length(b.x)) + 1e-9)"
    ).fetchall()
    group = roots(len(keys), links)
    first = {}
    for k, g in zip(keys, group, strict=True):
        first[g] = min(first.get(g, place[k]), place[k])
    kept = {k: first[g] for k, g in zip(keys, group, strict=True)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if not split(x) or kept[split(x)] == (d, i)) for d, t in rows}, len(links)


def test_line_dedup(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(5))
    bases = [[word() for _ in range(rng.choice((3, 8, 20, 60, 150)))] for _ in range(12)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(4):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = word()
            text.append(rng.choice(("{}", "{}.", "  {} !")).format(" ".join(line)))
        rows.append((d, "\n".join([*text, "", "--"])))
    want, n_links = plain_lines(rows)
    assert n_links > 20
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want


@pytest.fixture(scope="module")
def tree():
    import public_tokenizers

    return bpe.TreeBpe(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab're 'l\n\t 0é漢😀.,  "), max_size=300))
def test_bpe_tree_joins(tree, text):
    old = bpe.LEAF, bpe.SEAM
    bpe.LEAF, bpe.SEAM = 8, 2
    try:
        ids = tree.encode(text)
        assert ids == tree.encoding.encode_ordinary(text) and tree.decode(ids) == text.encode()
    finally:
        bpe.LEAF, bpe.SEAM = old


def test_bpe_of_documents(spark, tree):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    for r in op10_bpe(spark, SF).collect():
        ids = tree.encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=2000))
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_over_full_tables():
    rng = random.Random(0)
    for data in (bytes(rng.randrange(256) for _ in range(60_000)), b"ab" * 50_000, bytes(1)):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_gif_rules():
    """Two frames of 4 x 2 with a four-colour palette: transparency over a kept frame, an interlaced local palette, disposal."""
    import struct

    def stream(samples):  # literal codes of three bits, a clear code before every two
        bits, n = 0, 0
        for k, s in enumerate(samples):
            for code in ([4] if k % 2 == 0 else []) + [s]:
                bits |= code << n
                n += 3
        bits |= 5 << n
        return bits.to_bytes((n + 3 + 7) // 8, "little")

    def frame(disposal, transparent, delay, samples, flags=0, table=b""):
        packed = disposal << 2 | (transparent is not None)
        data = stream(samples)
        return (b"\x21\xf9\x04" + struct.pack("<BHBB", packed, delay, transparent or 0, 0)
                + b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 2, flags) + table + b"\x02" + bytes([len(data)]) + data + b"\0")

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    media = (b"GIF89a" + struct.pack("<HHBBB", 4, 2, 0x81, 0, 0) + palette + frame(1, None, 5, [1] * 8)
             + frame(2, 0, 7, [0, 2, 0, 2, 0, 0, 0, 0]) + frame(0, None, 9, [3, 3, 3, 3, 2, 2, 2, 2], 0xC1, palette[::-1]) + b"\x3b")
    a, b, c = gif.decode_gif(media)
    assert [f.delay_cs for f in (a, b, c)] == [5, 7, 9]
    assert (a.canvas[..., 0] == 255).all() and b.canvas[0, 1].tolist() == [0, 255, 0, 255] and b.canvas[0, 0].tolist() == [255, 0, 0, 255]
    assert c.canvas[0, 0].tolist() == [0, 0, 0, 255] and c.canvas[1, 0].tolist() == [0, 0, 255, 255]
    assert gif._deinterlace(np.array([0, 8, 4, 2, 6, 1, 3, 5, 7])[:, None])[:, 0].tolist() == list(range(9))
    assert gif.colour_histogram(a.canvas)[0b110000] == 8


def test_media_of_documents(spark):
    import hashlib
    import zlib

    texts = {r["doc_id"]: r["text"].encode() for r in documents(spark, SF).collect()}
    for r in op5_gif_media(spark, SF).collect():
        payload = texts[r["doc_id"]]
        payload = payload.ljust(max(1, -(-len(payload) // 192)) * 192)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in regex.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(digits[::-1][::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[::-1][1::2])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"),
                "card": 13 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("a@.b-+ 0149()%\n"), max_size=80))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data_of_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF2).collect()}
    for r in op4_personal_data(spark, SF2).collect():
        want = [":".join(map(str, s)) for s in plain_spans(texts[r["doc_id"]])]
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in want)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_entities_in_unknown_forms_are_added(spark):
    """Entities of documents not trained on, written as no pattern has them, alone and behind the document."""
    texts = [r["text"] or "" for r in documents(spark, SF2).orderBy("doc_id").collect()]
    texts = [t for t in texts if pii.base_spans(t)]
    train = texts[::2]
    p = pii.learn_potentials(pii.training_graph(train, [pii.matches(t) for t in train]))
    alone, beside, total = 0, 0, 0
    for i, text in enumerate(texts[1::2]):
        base = pii.base_spans(text)
        again, moved = pii.repunctuated(text, base, i)
        both, shift = f"{text}\n{again}", len(text) + 1
        hit = lambda found, k, a, b: any(k == x and s < b and a < e for x, s, e in found)
        found = pii.added_spans([again, both], [pii.base_spans(again), base], p)
        for k, a, b in moved:
            total += 1
            alone += hit(found[0] + pii.base_spans(again), k, a, b)
            beside += hit(found[1], k, a + shift, b + shift)
    assert total > 25 and alone >= 0.6 * total and beside >= 0.8 * total
    plain = pii.added_spans(["item 7 of 9 in version 2.0", "chapter 12, 2019 and 2020"], [[], []], p)
    assert plain == [[], []]


def test_field_adds_spans_to_the_documents(spark):
    assert sum(r["n_added"] for r in op4_personal_data(spark, SF2).collect()) > 0


def test_crf_carries_labels_to_distant_copies():
    """A number in a known phone's digits, written without its plus, is labelled like it across the document."""
    train = [f"word call +1 (0{k}7) 555-77{k:02d} now or mail us{k}@host{k}.example.com and version {k}.0 of item {k}" for k in range(40)]
    train += [f"call +491512345{k:02d}0 or later today +491512345{k:02d}0 but not item {k}" for k in range(40)]
    p = pii.learn_potentials(pii.training_graph(train, [pii.matches(t) for t in train]))
    text = "mail joe9@corp.example.com soon. " + "filler words here " * 200 + "again joe9@corp.example.com; item 7 of 9. Write joe9(at)corp.example.com"
    added = pii.added_spans([text, "item 7 of 9 in version 2.0"], [pii.base_spans(text), []], p)
    assert added == [[("email", text.index("joe9(at)"), len(text))], []]
    phone = "ring +491512345678 or, much later, " + "filler " * 300 + "491512345678 again"
    found = pii.added_spans([phone], [[s for s in pii.base_spans(phone) if s[0] == "phone"]], p)[0]
    assert ("phone", phone.index(" 4915") + 1, phone.index(" again")) in found


def test_targets_by_iteration(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 25):
        size = {f"s{k:02d}": rng.randint(0, 1000) ** 2 for k in range(n)} | {None: 5000}
        units = spark.createDataFrame([(k, s) for k, s in size.items()], "source string, size long")
        order = sorted(x for x in size if x is not None) + [None]
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, open_, left = {}, set(order), 1.5 * sum(size.values())
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = [s for s in open_ if share[s] > 2 * size[s]]
            for s in over or open_.copy():
                target[s] = 2.0 * size[s] if over else share[s]
                open_.discard(s)
                left -= target[s] if over else 0
        got = {r["source"]: r["target"] for r in mixing.targets(units).collect()}
        assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 * max(1, target[s]) for s in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), max_size=60), st.integers(0, 9))
def test_flight_keeps_both_totals(units, seed):
    pi, size = [p for p, _ in units], [n for _, n in units]
    out = mixing.flight(pi, size, random.Random(seed))
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(out) - sum(pi)) < 1e-5 * (1 + len(pi)) and abs(sum(p * n for p, n in zip(out, size)) - sum(p * n for p, n in zip(pi, size))) < 1e-2
    ended = mixing.landing(out, size, random.Random(seed))
    left = [k for k, p in enumerate(out) if 0 < p < 1]
    assert all(p in (0, 1) for p in ended) and all(ended[k] == p for k, p in enumerate(out) if k not in left)


def test_landing_takes_the_nearest_way():
    pi, size = [0.5, 0.5, 0.4, 0.6, 1.0, 0.0], [10, 7, 5, 12, 100, 50]
    out = mixing.landing(pi, size, random.Random(0))
    want = sum(p * n for p, n in zip(pi, size))
    ways = [[*w, 1.0, 0.0] for w in itertools.product((0.0, 1.0), repeat=4)]
    assert abs(sum(p * n for p, n in zip(out, size)) - want) <= min(abs(sum(p * n for p, n in zip(w, size)) - want) for w in ways) + 1
    assert abs(sum(out) - sum(pi)) <= 1


def test_flight_respects_the_probabilities():
    hits = np.zeros(6)
    pi, size = [0.2, 0.5, 0.7, 0.3, 0.9, 0.4], [1, 5, 9, 2, 2, 7]
    for seed in range(4000):
        hits += mixing.flight(pi, size, random.Random(seed))
    assert np.abs(hits / 4000 - pi).max() < 0.04


def test_mix_of_documents(spark):
    found = op7_mixing(spark, SF2)
    rows = found.collect()
    assert sorted(rows) == sorted(op7_mixing(spark, SF2).collect())
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    sources = {r["doc_id"]: r["source"] for r in documents(spark, SF2).collect()}
    taken, target = {}, {}
    for r in rows:
        taken[sources[r["doc_id"]]] = taken.get(sources[r["doc_id"]], 0) + r["taken"]
        target[sources[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.02 * target[s] for s in target)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op9_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    good = [r["score"] for r in rows if not r["toxic"]]
    bad = [r["score"] for r in rows if r["toxic"]]
    auc = np.mean([(np.array(good) < x).mean() for x in bad])
    assert auc > 0.95 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.01 * len(good)


def test_ftrl_equals_a_plain_recurrence():
    """Coordinate by coordinate, as published: per-coordinate rates, L1 and L2."""
    rng = random.Random(1)
    examples = [np.array(sorted(rng.sample(range(30), rng.randint(1, 8))), np.int64) for _ in range(120)]
    labels = [int(3 in x or 7 in x and rng.random() < 0.8) for x in examples]
    z, n, often = {}, {}, {}
    for x in examples:
        for k in x.tolist():
            often[k] = often.get(k, 0) + 1
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= toxicity.L1 else (
        (math.copysign(toxicity.L1, z[k]) - z[k]) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)
    )
    z0 = n0 = 0.0
    for _ in range(toxicity.EPOCHS):
        for x, y in zip(examples, labels):
            at = [k for k in x.tolist() if often[k] >= toxicity.MIN_SEEN]
            w = {k: weight(k) for k in at}
            b = -z0 / ((toxicity.BETA + math.sqrt(n0)) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for k in at:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[k]
                n[k] = old + g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / toxicity.ALPHA * b
            n0 += g * g
    used, weights, bias = toxicity.fit_ftrl(examples, labels)
    want = {k: weight(k) for k in z if weight(k)}
    assert want and set(used.tolist()) == set(want) and all(abs(w - want[k]) < 1e-9 for k, w in zip(used.tolist(), weights))
    assert abs(bias + z0 / ((toxicity.BETA + math.sqrt(n0)) / toxicity.ALPHA)) < 1e-9


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(0)
    examples = [np.unique(rng.integers(100, 5000, 80)) for _ in range(600)]
    labels = [k % 2 for k in range(600)]
    examples = [np.append([7] if y else [8], x) for x, y in zip(examples, labels, strict=True)]
    used, weights, _ = toxicity.fit_ftrl(examples, labels)
    w = dict(zip(used.tolist(), weights, strict=True))
    assert w[7] > 0 > w[8] and len(used) < 500


def test_lm_orders(spark):
    """Trigrams as well as pairs, against counting in dictionaries."""
    rng = random.Random(1)
    rows = [(d, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))) for d in range(30)] + [(30, None), (31, "a b c"), (32, "a b c")]
    import math
    from collections import Counter

    toks = [(t or "").split() for _, t in rows]
    total = sum(map(len, toks))
    for order in (1, 2, 3):
        grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))  # noqa: B023, E731
        own = [grams(w) for w in toks]
        everything = sum(own, Counter())
        found = {r["doc_id"]: r["log10_score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()}
        for (d, _), w, mine in zip(rows, toks, own, strict=True):
            want = 0.0
            for i in range(len(w)):
                for n in range(min(order, i + 1), 0, -1):
                    g = tuple(w[i - n + 1 : i + 1])
                    c = everything[g] - mine[g]
                    if n == 1:
                        want += math.log10(max(c, 1) / total)
                    elif c > 0:
                        want += math.log10(c / (everything[g[:-1]] - mine[g[:-1]]))
                        break
                    else:
                        want += math.log10(lm.BACKOFF)
            assert abs(found[d] - want) < 1e-6


def test_components(spark):
    from glossarion.llm.graph import components

    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = roots(300, edges)
    assert found == {n: group[n] for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame(edges, "a long, b long").limit(0)).count() == 0
