"""Personal data: fixed patterns, and a skip-chain conditional random field beside them.

The patterns give the base spans. The field labels every token that holds a digit or
an at-sign (also one written in brackets) as one of the four kinds or as none. Its nodes are joined in a chain where
tokens stand side by side, and by skip edges where tokens repeat: a token is joined to
the one before it with the same letters and digits, or with the same six or more
digits, and to the first such token inside a base span. Tokens inside base spans are observed; loopy belief propagation, until
its messages settle, carries their labels along both kinds of edges, so that a repeated or re-punctuated copy of an entity
is labelled like it, however far away it stands. Nodes whose belief in a kind reaches
``CERTAIN`` become added spans. A token has at most four skip edges, so a document's graph is as long as the document.

The potentials are learned by pseudo-likelihood from a bounded sample: the
``max_documents`` first texts, by hash, that hold a digit or at-sign. The patterns alone would teach the field to say
none wherever they fail, so labels are not theirs as they stand: matches that a pattern drops (a run of digits too long as another number
stands beside it, a check digit that does not fit) count neither as entity nor as none, and each sample
text is seen again with its entities re-punctuated, in forms that no pattern matches, under the labels they had, alone and
behind the text itself; sentences with plain numbers are added as well.

Defined results: a null text is the empty string and has no spans; equal texts have
equal spans; without a document to learn from no spans are added; an empty table gives
no rows; other input columns are ignored. Offsets count code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
MAX_DOCUMENTS = 2000
#: Most rounds of messages; they end once no message moves by SETTLED.
ROUNDS, SETTLED = 100, 1e-4
CERTAIN = 0.9
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_HIT = re.compile(r"[0-9@]")
_NODE = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
_AT = re.compile(r"[(\[]at[)\]]", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# No earlier start in the same run of digits can fail where a later one matches.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_NO_KEY = re.compile(r"[\W_]+")
_EDGES = ".,;:!?()[]{}\"'"

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and start."""
    return matches(text)[0]


def matches(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and the matches that are dropped since their numbers don't fit."""
    out: list[Span] = []
    dropped: list[Span] = []
    if not _HIT.search(text):
        return out, dropped
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            done = host.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        (out if fits else dropped).append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 13 <= len(digits):
            (out if len(digits) <= 19 and _luhn(digits) else dropped).append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        fits = 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15
        (out if fits else dropped).append(("phone", m.start(), m.end()))
    return out, dropped


def repunctuated(text: str, spans: list[Span], way: int) -> tuple[str, list[Span]]:
    """The text with its entities written in another way, of which there are three a kind, and where they stand then."""
    out, moved, done = [], [], 0
    length = 0
    for k, (kind, start, end) in enumerate(sorted(spans, key=lambda x: x[1:])):
        if start < done:
            continue
        old, w = text[start:end], (way + k) % 3
        digits = _NO_DIGIT.sub("", old)
        if kind == "email":
            new = old.replace("@", ("[at]", "(at)", "@@")[w])
        elif kind == "ip":
            new = old.replace(".", ("[.]", "-", ",")[w])
        elif kind == "card":
            new = "./_"[w].join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            sep = ".-/"[w]
            new = ("", "00", "")[w] + sep.join([digits[:-10] or "0", digits[-10:-7], digits[-7:-4], digits[-4:]])
        out += [text[done:start], new]
        length += start - done
        moved.append((kind, length, length + len(new)))
        length += len(new)
        done = end
    return "".join([*out, text[done:]]), moved


def nodes_of(text: str) -> list[tuple[int, int]]:
    """The tokens with a digit or at-sign, trimmed of outer punctuation."""
    out, m = [], _NODE.search(text)
    while m:
        start = m.start()
        floor = out[-1][1] if out else 0
        while start > floor and text[start - 1] not in _SPACES:
            start -= 1
        blank = _SPACE.search(text, m.end())
        end = stop = blank.start() if blank else len(text)
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while start < end and text[start] in _EDGES:
            start += 1
        if start < end:
            out.append((start, end))
        m = _NODE.search(text, stop)
    return out


def _features(token: str, before: str, after: str) -> list[bool]:
    token = _AT.sub("@", token)
    n = len(_NO_DIGIT.sub("", token))
    letters = any(c.isalpha() for c in token)
    return [
        True, "@" in token, "@" in token and "." in token.partition("@")[2], token.count(".") == 3 and not letters, n == len(token),
        n == 0, 1 <= n <= 3, 4 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19, "-" in token, "(" in token, ")" in token,
        "+" in token, letters, letters and n > 0, ":" in token or "/" in token, len(token) <= 4, len(token) > 12,
        before.isdigit(), before == "+", after.isdigit(), after == "(",
    ]


@dataclass
class Graph:
    """The disjoint union of documents' graphs. edges: pairs of nodes; label -1: not observed."""

    features: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    spans: list[tuple[int, int]]
    document: np.ndarray
    doubtful: np.ndarray


def build_graph(texts: list[str], bases: list[list[Span]], dropped: list[list[Span]] | None = None) -> Graph:
    """dropped: spans whose tokens are neither entities nor none when the field is trained."""
    features, observed, chain, skip, spans, document, doubtful = [], [], [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        own, last, first, previous_end = nodes_of(text), {}, {}, -9
        doubts = dropped[d] if dropped else []
        covered = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
        for start, end in own:
            node = len(spans)
            token = text[start:end]
            features.append(_features(token, text[max(0, start - 2) : start].strip(), text[end : end + 2].strip()[:1]))
            inside = [k for a, b, k in covered if a < end and start < b] if covered else []
            observed.append(inside[0] if inside else -1)
            doubtful.append(not inside and any(a < end and start < b for _, a, b in doubts))
            if 0 <= start - previous_end <= 2:
                chain.append((node - 1, node))
            previous_end = end
            digits = _NO_DIGIT.sub("", token)
            for key in (_NO_KEY.sub("", _AT.sub("@", token)).lower(), ("digits", digits) if len(digits) >= 6 else ""):
                if key:
                    skip += [(x, node) for x in dict.fromkeys((last.get(key, node), first.get(key, node))) if x != node]
                    last[key] = node
                    if inside:
                        first.setdefault(key, node)
            spans.append((start, end))
            document.append(d)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    n = len(_features("", "", ""))
    return Graph(
        np.array(features, float).reshape(-1, n), np.array(observed, np.int64), pairs(chain), pairs(skip), spans,
        np.array(document, np.int64), np.array(doubtful, bool),
    )


@dataclass
class Potentials:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def training_graph(texts: list[str], found: list[tuple[list[Span], list[Span]]]) -> Graph:
    """Each text, and again followed by itself re-punctuated, so that copies are seen beside what they are copies of."""
    rows = [(t, *f) for t, f in zip(texts, found, strict=True)]
    for i, (text, base, dropped) in enumerate(rows[:]):
        again, moved = repunctuated(text, base, i)
        if moved:
            shift = len(text) + 1
            rows.append((f"{text}\n{again}", base + [(k, a + shift, b + shift) for k, a, b in moved], dropped))
            rows.append((again, moved, []))
    # Plain numbers, which a small sample may lack altogether.
    plain = [f"{i % 9} of {i}, page {3 * i} in {1950 + i} or version {i % 7}.{i % 5}, {100 * i} times, {i}th" for i in range(1, 1 + len(texts))]
    return build_graph(*map(list, zip(*rows, *((t, [], []) for t in plain), strict=True)))


def learn_potentials(graph: Graph, steps: int = 1500, rate: float = 0.3, decay: float = 1e-5) -> Potentials | None:
    """Maximum pseudo-likelihood by gradient ascent with a rate for each weight; labels are the observed ones, 0 for the rest; doubtful nodes don't count."""
    k, n = len(KINDS) + 1, len(graph.observed)
    if not n or not (graph.observed > 0).any():
        return None
    label = np.maximum(graph.observed, 0)
    one = np.eye(k)[label]
    one[graph.doubtful] = 0
    sure = ~graph.doubtful[:, None]
    sides = {}
    for name, edges in (("chain", graph.chain), ("skip", graph.skip)):
        left, right = np.zeros((n, k)), np.zeros((n, k))
        np.add.at(left, edges[:, 1], one[edges[:, 0]])
        np.add.at(right, edges[:, 0], one[edges[:, 1]])
        sides[name] = (left, right)
    weights = {"unary": np.zeros((graph.features.shape[1], k)), "chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
    squares = {name: np.full(w.shape, 1e-8) for name, w in weights.items()}
    for _ in range(steps):
        score = graph.features @ weights["unary"]
        for name, (left, right) in sides.items():
            score += left @ weights[name] + right @ weights[name].T
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        gap = (one - p) * sure / n
        step_of = {"unary": graph.features.T @ gap}
        for name, (left, right) in sides.items():
            both = left.T @ gap + (right.T @ gap).T
            step_of[name] = both + both.T
        for name, step in step_of.items():
            step = step - decay * weights[name]
            squares[name] += step * step
            weights[name] += rate * step / np.sqrt(squares[name])
    unary, pair = weights["unary"], weights
    return Potentials(unary, pair["chain"], pair["skip"])


def beliefs(graph: Graph, potentials: Potentials) -> np.ndarray:
    """Marginals of every node by loopy sum-product message passing, damped by half."""
    k, n = len(KINDS) + 1, len(graph.observed)
    score = graph.features @ potentials.unary
    seen = graph.observed >= 0
    score[seen] = -30.0
    score[seen, graph.observed[seen]] = 0.0
    score -= score.max(1, keepdims=True)
    from_ = np.concatenate([graph.chain[:, 0], graph.skip[:, 0]])
    to = np.concatenate([graph.chain[:, 1], graph.skip[:, 1]])
    table = np.concatenate(
        [np.repeat(potentials.chain[None], len(graph.chain), 0), np.repeat(potentials.skip[None], len(graph.skip), 0)]
    )
    sources, targets = np.concatenate([from_, to]), np.concatenate([to, from_])
    table = np.exp(np.concatenate([table, table.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(from_)) + len(from_), np.arange(len(from_))])
    message = np.zeros((len(sources), k))

    def total() -> np.ndarray:
        out = score.copy()
        np.add.at(out, targets, message)
        return out

    for _ in range(ROUNDS if len(sources) else 0):
        cavity = total()[sources] - message[back]
        cavity = np.exp(cavity - cavity.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", cavity, table) + 1e-300)
        new = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        moved, message = np.abs(new - message).max(), new
        if moved < SETTLED:
            break
    out = total()
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True) if n else out


def added_spans(texts: list[str], bases: list[list[Span]], potentials: Potentials | None) -> list[list[Span]]:
    """For each text, what the field finds beside the base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    if potentials is None:
        return out
    graph = build_graph(texts, bases)
    if len(graph.spans) == 0:
        return out
    belief = beliefs(graph, potentials)
    best = belief.argmax(1)
    for node in np.flatnonzero((graph.observed < 0) & (best > 0) & (belief.max(1) >= CERTAIN)):
        out[graph.document[node]].append((KINDS[best[node] - 1], *graph.spans[node]))
    return out


def learn(docs: DataFrame, text_col: str = "text", max_documents: int = MAX_DOCUMENTS) -> Potentials | None:
    small_batches(docs.sparkSession)
    texts = docs.select(docs[text_col].cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    hashed = texts.select(F.xxhash64("text").alias("h"), "text")
    # Hashes first, so that the texts of no more than the sample meet in one task.
    first = hashed.select("h").distinct().orderBy("h").limit(max_documents)
    chosen = hashed.join(F.broadcast(first), "h", "left_semi").dropDuplicates(["h"]).select("text").repartition(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = sorted(t for b in batches for t in b["text"])
        found = [matches(t) for t in texts]
        p = learn_potentials(training_graph(texts, found)) if texts else None
        if p:
            yield pd.DataFrame({"name": ["unary", "chain", "skip"], "value": [x.ravel().tolist() for x in (p.unary, p.chain, p.skip)]})

    rows = {r["name"]: np.array(r["value"]) for r in chosen.mapInPandas(run, "name string, value array<double>").collect()}
    k = len(KINDS) + 1
    return Potentials(*(rows[x].reshape(-1, k) for x in ("unary", "chain", "skip"))) if rows else None


def find_personal_data(
    docs: DataFrame, potentials: Potentials | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, spans array<struct<kind, start, end, added>> by kind as listed, then start."""
    small_batches(docs.sparkSession)
    picked = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    kind = picked.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = added_spans(texts, bases, potentials)
            rows = []
            for base, more in zip(bases, added, strict=True):
                found = [(*s, False) for s in base] + [(*s, True) for s in more]
                found.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                rows.append([dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in found])
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "spans": pa.array(rows, pa.list_(item))})

    return picked.mapInArrow(
        run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,added:boolean>>"
    )
