"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles; equal sets are one class. Each
class has minwise values under many hash functions. In every one of several
independent trees, a node selects one or two of these functions, more than 1 /
similarity on average, and sends each of its documents to the children named by
the selected minwise tokens. Pairs at the threshold or above thus keep meeting with a
probability that hardly falls with the depth, and the number of trees brings their
recall to the target; other pairs part. Small nodes are compared exhaustively by
sketches; larger ones branch on.

Of the plausible pairs of a node, a spanning forest of the most similar ones is
confirmed first on the full sets. Members that have further plausible partners
are kept aside; once components are known, pairs that still cross components are
confirmed inside their node, so a large group never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, tidy, written

#: Minwise functions, bytes of the sketch that travels with a row, standard errors of slack in the sketch test.
MINWISE, SKETCH, SLACK = 128, 64, 4.5
#: Independent trees, levels before the first comparison (and between later ones).
TREES, DEPTH = 8, 3
#: Branches that a pair at the threshold is expected to share a level: above 1, so that it goes on meeting at every depth.
SHARED = 1.0625
#: Nodes of at most this many classes are compared exhaustively.
SMALL = 4096
_RNG = np.random.default_rng(30)
_ODD = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_FUNCTION = _RNG.integers(1, 1 << 63, (MINWISE, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingles(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. A-Z count as a-z, words
    are what white space (x20, x09 to x0D) separates; fewer than ``size`` words make one
    shingle, none makes none."""
    raw = (text or "").encode().lower()  # of bytes: A-Z only
    b = np.frombuffer(raw, np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _powers(_BASE, len(b)), dtype=np.uint64)])
    h = _mix((upto[end] - upto[start]) * _powers(_INVERSE, len(b))[start] + (end - start).astype(np.uint64) * _ODD[0])
    size = min(size, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mix(total * _ODD[1] + h[i:len(h) - size + 1 + i])
    return np.unique(total)


def minwise(s: np.ndarray) -> np.ndarray:
    """The least value of each function over a set, as uint32 (MINWISE of them)."""
    out = np.empty(MINWISE, np.uint32)
    for i in range(0, MINWISE, 16):
        f = _FUNCTION[i:i + 16]
        out[i:i + 16] = ((s[None, :] * f[:, :1] + f[:, 1:]) >> np.uint64(32)).min(axis=1)
    return out


def _sketches(size: int):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"doc_id": pdf["doc_id"], "h": pdf["h"], "n": [], "a": [], "b": [], "mins": []}
            for text in pdf["text"]:
                s = shingles(text, size)
                out["n"].append(len(s))
                out["a"].append(int(_mix(s * _ODD[2]).sum(dtype=np.uint64).astype(np.int64)))
                out["b"].append(int(np.bitwise_xor.reduce(_mix(s * _ODD[3] + _ODD[4])).astype(np.int64)) if len(s) else 0)
                out["mins"].append(minwise(_mix(s)).tobytes() if len(s) else None)
            yield pd.DataFrame(out)
    return run


def second_branch(percent: int) -> float:
    """Chance of a node's second branch, from the similarity: a level then has SHARED / similarity branches on average."""
    return min(1.0, max(0.0, SHARED * 100 / percent - 1))


def _branch(node: np.ndarray, row: np.ndarray, mins: np.ndarray, levels: int, second: float) -> tuple[np.ndarray, np.ndarray]:
    """Children after ``levels`` of (node, row of mins): the node selects the functions."""
    for _ in range(levels):
        pick = _mix(node * _ODD[5] + np.uint64(1))
        first = (pick & np.uint64(0xFFFFFFFF)) % np.uint64(MINWISE)
        more = np.flatnonzero((pick >> np.uint64(32)) < np.uint64(round(second * (1 << 32))))
        step = np.uint64(1) + (_mix(node[more]) % np.uint64(MINWISE - 1))
        f = np.concatenate([first, (first[more] + step) % np.uint64(MINWISE)])
        node, row = np.concatenate([node, node[more]]), np.concatenate([row, row[more]])
        node = _mix(node * _ODD[6] + (mins[row, f.astype(np.int64)].astype(np.uint64) << np.uint64(8)) + f)
    return node, row


def _roots(trees: int, depth: int, second: float):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mins = np.frombuffer(b"".join(pdf["mins"]), np.uint32).reshape(-1, MINWISE)
            ids, short = pdf["id"].to_numpy(), _short(mins)
            row = np.tile(np.arange(len(ids)), trees)
            node, row = _branch(_mix(np.repeat(np.arange(trees, dtype=np.uint64), len(ids)) + _ODD[7]), row, mins, depth, second)
            yield pd.DataFrame({"node": node.astype(np.int64), "id": ids[row], "sketch": short[row]})
    return run


def _short(mins: np.ndarray) -> np.ndarray:
    low = np.ascontiguousarray((_mix(mins[:, :SKETCH].astype(np.uint64)) & np.uint64(255)).astype(np.uint8))
    return np.array([r.tobytes() for r in low] + [None], dtype=object)[:-1]


def _children(depth: int, second: float):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mins = np.frombuffer(b"".join(pdf["mins"]), np.uint32).reshape(-1, MINWISE)
            node, row = _branch(pdf["node"].to_numpy().astype(np.uint64), np.arange(len(pdf)), mins, depth, second)
            yield pd.DataFrame({"node": node.astype(np.int64), **{c: pdf[c].to_numpy()[row] for c in ("id", "sketch", "comp")}})
    return run


def _matrix(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)


def _agreement(sk: np.ndarray) -> np.ndarray:
    """How many sketch bytes each pair shares; 0 with itself."""
    out = np.empty((len(sk), len(sk)), np.uint8)
    step = max(1, (1 << 24) // (SKETCH * len(sk)))
    for i in range(0, len(sk), step):
        out[i:i + step] = (sk[i:i + step, None, :] == sk[None, :, :]).sum(axis=2)
    np.fill_diagonal(out, 0)
    return out


def _forest(shared: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A maximum spanning forest of the pairs that share ``least`` or more."""
    best, parent, out = shared[0].astype(np.int16), np.zeros(len(shared), np.int64), []
    best[0] = -1
    for _ in range(len(shared) - 1):
        i = int(best.argmax())
        if best[i] >= least:
            out.append((int(parent[i]), i))
        done = best < 0
        better = shared[i] > best
        parent[better], best[better] = i, shared[i][better]
        best[done] = -1
        best[i] = -1
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches sorted by node, regrouped so that no node is cut; with the bounds of its nodes."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
        node = pdf["node"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        held = pdf.iloc[cut[-1]:]
        if len(cut) > 1:
            yield pdf.iloc[:cut[-1]], cut
    if held is not None and len(held):
        yield held.reset_index(drop=True), np.array([0, len(held)])


COMPARED = "node long, id long, other long, sketch binary"


def _compare(least: int):
    """Forest pairs (id, other), and members that have further plausible partners (other is null)."""
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cut in _runs(batches):
            size = np.diff(cut)
            ids, node = pdf["id"].to_numpy(), pdf["node"].to_numpy()
            sketch = pdf["sketch"].to_numpy()
            left, right, aside = [], [], []
            two = cut[:-1][size == 2]
            if len(two):
                ok = (_matrix(sketch[two]) == _matrix(sketch[two + 1])).sum(axis=1) >= least
                left.append(two[ok])
                right.append(two[ok] + 1)
            for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                shared = _agreement(_matrix(sketch[at:at + n]))
                if not (plausible := shared >= least).any():
                    continue
                edges = np.array(_forest(shared, least)).reshape(-1, 2)
                left.append(at + edges[:, 0])
                right.append(at + edges[:, 1])
                plausible[edges[:, 0], edges[:, 1]] = plausible[edges[:, 1], edges[:, 0]] = False
                aside.append(at + np.flatnonzero(plausible.any(axis=1)))
            a, b, rest = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right, aside))
            a, b = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            yield pd.DataFrame({"node": np.zeros(len(a), np.int64), "id": a, "other": pd.array(b, "Int64"), "sketch": None})
            yield pd.DataFrame({"node": node[rest], "id": ids[rest], "other": pd.array([None] * len(rest), "Int64"), "sketch": sketch[rest]})
    return run


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _confirm(size: int, percent: int):
    """Keeps the pairs (u, v, text_u, text_v) that link by their full sets."""
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets: dict[str, np.ndarray] = {}
            for t in pd.concat([pdf["text_u"], pdf["text_v"]]):
                if t not in sets:
                    sets[t] = shingles(t, size)
            ok = [similar(sets[a], sets[b], percent) for a, b in zip(pdf["text_u"], pdf["text_v"], strict=True)]
            yield pdf.loc[ok, ["u", "v"]]
    return run


def _confirm_inside(least: int, size: int, percent: int):
    """Links between components, from members of a node with their full texts:
    enough of them to join every two components that a pair of the node links."""
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cut in _runs(batches):
            out = []
            for at, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                group = pdf.iloc[at:end]
                comp = np.unique(group["comp"], return_inverse=True)[1]
                if comp.max() == 0:
                    continue
                plausible, ids = _agreement(_matrix(group["sketch"])) >= least, group["id"].to_numpy()
                sets = [shingles(t, size) for t in group["text"]]
                for i in range(len(sets)):
                    for j in np.flatnonzero(plausible[i, i + 1:] & (comp[i + 1:] != comp[i])) + i + 1:
                        if comp[j] != comp[i] and similar(sets[i], sets[j], percent):
                            out.append((ids[i], ids[j]))
                            comp[comp == comp[j]] = comp[i]
            yield pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)
    return run


def least_agreement(percent: int) -> int:
    p = percent / 100
    return int(np.floor(SKETCH * max(0.0, p - SLACK * (p * (1 - p) / SKETCH) ** 0.5)))


def similar_documents(docs: DataFrame, size: int = 3, percent: int = 85, trees: int = TREES, depth: int = DEPTH,
                      small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for every row of ``docs`` (doc_id, text).

    Documents link if ``100 * |intersection| >= percent * |union|`` of their full
    shingle sets; a pair at exactly the threshold meets in some tree with
    probability over 0.999 at depth 3, where all but large nodes are compared; inside
    large nodes it falls to 0.997, 0.989 and 0.976 at depths 6, 9 and 12 (80 %; 0.999,
    0.996 and 0.991 at 85 %). Texts without a word, null texts and rows without a
    doc_id link with nothing and are their own component. Rows of one doc_id with
    different texts are compared like different documents.
    """
    least = least_agreement(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    sketches = written(rows.mapInPandas(_sketches(size), "doc_id long, h long, n long, a long, b long, mins binary"), "path-sketches")
    named = sketches.where("doc_id IS NOT NULL AND n > 0").withColumn("id", F.xxhash64("a", "b", "n"))
    classes = written(named.groupBy("id").agg(F.min("doc_id").alias("rep"), F.min_by("h", F.struct("doc_id", "h")).alias("h"),
                                             F.min_by("mins", F.struct("doc_id", "h")).alias("mins")), "path-classes")
    several = not named.groupBy("doc_id").count().where("count > 1").isEmpty()

    def texts(ids: DataFrame) -> DataFrame:
        """(id, text) of classes: the text of the class's first row."""
        wanted = classes.join(ids, "id").select("id", F.col("rep").alias("doc_id"), "h")
        found = rows.join(wanted, ["doc_id", "h"]).select("id", "text")
        return written(found.dropDuplicates(["id"]) if several else found, "path-texts")

    links = []
    state = classes.select("id", "mins").mapInPandas(_roots(trees, depth, second_branch(percent)), "node long, id long, sketch binary")
    while True:
        large = written(state.groupBy("node").count().where(F.col("count") > small).select("node"), "path-large")
        any_large = not large.isEmpty()
        fit = state.join(large, "node", "left_anti") if any_large else state
        compared = written(fit.repartition("node").sortWithinPartitions("node", "id").mapInPandas(_compare(least), COMPARED), "path-compared")
        pairs = compared.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v"))
        if any_large:
            inside = written(state.join(large, "node"), "path-inside")
            pivot = inside.groupBy("node").agg(F.min_by("id", F.xxhash64("node", "id")).alias("pivot"))
            pairs = pairs.union(inside.join(written(pivot, "path-pivots"), "node").where("id <> pivot")
                                .select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")))
        pairs = written(pairs.distinct(), "path-pairs")
        aside = compared.where("other IS NULL").select("node", "id", "sketch")
        known = texts(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).union(aside.select("id")).distinct())
        sided = (pairs.join(known.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
                 .join(known.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v"))
        links.append(written(sided.mapInPandas(_confirm(size, percent), "u long, v long"), "path-links"))
        comps = written(connected_components(reduce(DataFrame.union, links)), "path-components")
        member = aside.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        mixed = member.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("node")
        open_rows = written(member.join(mixed, "node"), "path-open")
        if not open_rows.isEmpty():
            crossing = (open_rows.join(known, "id").repartition("node").sortWithinPartitions("node", "id")
                        .mapInPandas(_confirm_inside(least, size, percent), "u long, v long"))
            links.append(written(crossing, "path-links"))
            comps = written(connected_components(reduce(DataFrame.union, links)), "path-components")
        if not any_large:
            break
        below = (inside.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id"))
                 .join(classes.select("id", "mins"), "id").select("node", "id", "sketch", "comp", "mins")
                 .mapInPandas(_children(depth, second_branch(percent)), "node long, id long, sketch binary, comp long"))
        below = written(below, "path-below")
        mixed = below.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("node")
        state = written(below.join(mixed, "node").select("node", "id", "sketch"), "path-state")
    by_class = classes.select("id", "rep").join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    least_doc = by_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = written(by_class.join(least_doc, "comp").select("id", "component_id"), "path-result")
    return (sketches.withColumn("id", F.when(F.col("n") > 0, F.xxhash64("a", "b", "n"))).join(found, "id", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
