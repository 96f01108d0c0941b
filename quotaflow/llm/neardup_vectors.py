"""Embedding near-duplicates by int8 tile products.

Equal vectors of a label are one class. The classes of a label are dealt to
tiles; every pair of tiles of the label is one row of work. A unit vector u is kept
as int8 codes with one scale, ``u = s * c + r``; its residual length bounds the
error of a product rigorously: ``|<u,v> - s_u s_v <c_u,c_v>| <= |r_v| + |r_u| (1 +
|r_v|)``. Pairs surely above or below the threshold are decided by the int8
product; only the rest is recomputed from the original vectors in double precision.

Tile pairs meet in their codes alone. A pair of tiles gives the counts and the forest of
its sure links, and the rows that have undecided pairs (never the pairs); those rows
fetch their original vectors and meet once more, so doubles move for them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, written
from .tiles import matrix, stack, units, valid_vectors

TILE = 1024
#: Slack for the rounding of the double-precision sums themselves.
SLACK = 1e-9
#: Undecided pairs recomputed at a time.
PAIRS = 1 << 16

TILE_SCHEMA = "label string, tile int, tiles int, dim int, ids binary, n binary, codes binary, scale binary, err binary"


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and residual lengths (rounded up) of unit rows."""
    scale = np.abs(u).max(axis=1) / 127.0
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    rest = u - scale[:, None] * codes
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-12


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for dim, rows in pdf.groupby(pdf["embedding"].map(len), sort=True):
        raw = stack(rows["embedding"])
        codes, scale, err = quantise(units(raw))
        out.append({"label": rows["label"].iloc[0], "tile": rows["tile"].iloc[0], "tiles": rows["tiles"].iloc[0], "dim": dim,
                    "ids": rows["rep"].to_numpy(np.int64).tobytes(), "n": rows["n"].to_numpy(np.int64).tobytes(),
                    "codes": codes.tobytes(), "scale": scale.tobytes(), "err": err.tobytes()})
    return pd.DataFrame(out)


def linked(a: tuple, b: tuple, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of tiles a and b (codes, scale, err) surely reach the threshold,
    and which may: those need their original vectors."""
    wide = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of the int8 products stay exact
    dots = (a[0].astype(wide) @ b[0].astype(wide).T).astype(np.float64)
    est = dots * a[1][:, None] * b[1][None, :]
    err = b[2][None, :] + a[2][:, None] * (1 + b[2][None, :]) + SLACK
    links = est - err >= threshold
    return links, ~links & (est + err >= threshold)


def _forest(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id reachable inside a symmetric link matrix."""
    least = ids.copy()
    while True:
        nxt = np.minimum(least, np.where(links, least[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (nxt == least).all():
            return least
        least = nxt


def _summed(links: np.ndarray, ids: np.ndarray, n: np.ndarray, b_ids: np.ndarray, b_n: np.ndarray, same: bool) -> pd.DataFrame:
    """u, v, links of a link matrix: u's number of links and the least id v reached inside it."""
    if same:
        links = links | links.T
        np.fill_diagonal(links, False)
        keep = np.flatnonzero(links.any(axis=1))
        square, counts, ids = links[np.ix_(keep, keep)], (links @ n)[keep], ids[keep]
    else:
        x, y = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
        part = links[np.ix_(x, y)]
        square = np.zeros((len(x) + len(y),) * 2, dtype=bool)
        square[:len(x), len(x):], square[len(x):, :len(x)] = part, part.T
        counts = np.concatenate([part @ b_n[y], part.T @ n[x]])
        ids = np.concatenate([ids[x], b_ids[y]])
    return pd.DataFrame({"u": ids, "v": _forest(square, ids) if len(ids) else ids, "links": counts})


def _compare(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                def side(p, r=r):
                    g = lambda name, kind: np.frombuffer(getattr(r, p + name), kind)
                    return (matrix(getattr(r, p + "codes"), r.dim, np.int8), g("scale", np.float64), g("err", np.float64)), g("ids", np.int64), g("n", np.int64)

                (a, ids, n), (b, b_ids, b_n) = side(""), side("b_")
                sure, unsure = linked(a, b, r.dim, threshold)
                same = r.tile == r.b_tile
                if same:
                    np.fill_diagonal(unsure, False)
                    unsure |= unsure.T  # the bounds of a pair differ with its order
                found = _summed(sure, ids, n, b_ids, b_n, same)
                yield found.assign(label=r.label, tile=r.tile, b_tile=r.b_tile, side=-1)
                for at, rows in ((0, ids[unsure.any(axis=1)]), (1, b_ids[unsure.any(axis=0)])):
                    if len(rows) and not (same and at):
                        yield pd.DataFrame({"u": rows, "v": rows, "links": 0}).assign(label=r.label, tile=r.tile, b_tile=r.b_tile, side=at)
    return run


def _decide(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = bool((pdf["tile"] == pdf["b_tile"]).iloc[0])
        one, two = (pdf if same else pdf[pdf["side"] == at] for at in (0, 1))
        (a, ids, n), (b, b_ids, b_n) = ((units(stack(p["embedding"])), p["u"].to_numpy(np.int64), p["n"].to_numpy(np.int64)) for p in (one, two))
        # The tiles' own codes and bounds again, as they follow from a vector alone.
        sure, unsure = linked(quantise(a), quantise(b), a.shape[1], threshold)
        if same:
            sure, unsure = sure | sure.T, unsure | unsure.T
        links, (i, j) = np.zeros_like(sure), np.nonzero(unsure & ~sure)
        for k in range(0, len(i), PAIRS):
            x, y = i[k:k + PAIRS], j[k:k + PAIRS]
            links[x, y] = (a[x] * b[y]).sum(axis=1) >= threshold
        return _summed(links, ids, n, b_ids, b_n, same)
    return run


def embedding_components(embeddings: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for every row of
    ``embeddings`` (vec_id, embedding, label).

    Vectors of equal, non-null labels link at a cosine of ``threshold`` or more
    (double precision). A vector that is null, empty, zero or holds null or
    non-finite components, or has no label or id, links with nothing; so do
    vectors of different dimension. Repeated rows are vectors of their own. An empty
    table gives no rows. Other columns are ignored, whatever their names. A vec_id names
    one vector; a vector must be small against a task, as a tile holds ``tile`` of them.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                             F.col("label").cast("string").alias("label"))
    usable = valid_vectors(rows).where("label IS NOT NULL")
    classes = written(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    tiles = classes.groupBy("label").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = (classes.join(tiles, "label")
             .withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("tiles").cast("long")).cast("int")))
    packed = written(dealt.groupBy("label", "tile").applyInPandas(_pack, TILE_SCHEMA), "vector-tiles")
    left = packed.withColumn("b_tile", F.explode(F.sequence("tile", F.col("tiles") - 1)))
    right = packed.select(F.explode(F.sequence(F.lit(0), "tile")).alias("tile"), F.col("tile").alias("b_tile"), "label", "dim", *[
        F.col(c).alias(f"b_{c}") for c in ("ids", "n", "codes", "scale", "err")])
    pairs = left.join(right, ["label", "dim", "tile", "b_tile"])
    met = written(pairs.mapInPandas(_compare(threshold), "u long, v long, links long, label string, tile int, b_tile int, side int"), "vector-links")
    originals = classes.select(F.col("rep").alias("u"), "label", "embedding", "n", F.size("embedding").alias("dim"))
    again = (met.where("side >= 0").select("u", "label", "tile", "b_tile", "side").join(originals, ["label", "u"])
             .groupBy("label", "tile", "b_tile", "dim").applyInPandas(_decide(threshold), "u long, v long, links long"))
    found = written(met.where("side < 0").select("u", "v", "links").union(again), "vector-reach")
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("u", "v"))
    by_class = written(classes.join(counts, F.col("rep") == F.col("u"), "left").join(groups, F.col("rep") == F.col("id"), "left").select(
        F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c")), "vector-result")
    # Invalid vectors differ from every class, so the left join leaves them alone.
    return (rows.join(by_class, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding"))
                      & F.col("vec_id").isNotNull(), "left")
            .withColumn("component_id", F.coalesce("c", "vec_id"))
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


ORACLE_OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT l.v, r.r FROM reach r JOIN links l ON l.u = r.id),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.id = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
