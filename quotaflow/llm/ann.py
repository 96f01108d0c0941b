"""Approximate nearest neighbours by randomly rotated one-bit codes.

Unit vectors are rotated by a random orthogonal matrix and kept as one sign bit
a dimension, with one correction scalar: ``a = <o, code>``, the inner product
of the rotated vector and its own unit code. ``<code, q> / a`` estimates the
cosine, and lies within ``eps * sqrt((1 - a*a) / (a*a)) / sqrt(dim - 1)`` of it
but for a probability that falls off exponentially in eps squared. In each block
the vectors whose upper bound reaches the k-th largest lower bound are reranked by
the exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import parallelism, table
from .tiles import matrix, stack, units, valid_vectors

#: Width of the error bounds; vectors in an index or query block.
EPS, BLOCK = 3.0, 4096


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix (float64, dim x dim)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def index_blocks(vectors: DataFrame, groups: int, seed: int = 5) -> DataFrame:
    """Every vector's code, in blocks: g (0 to groups - 1), dim, ids, vectors
    (float64), packed bits and scalars. A block has at most BLOCK vectors of one
    dimension."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (g, dim), rows in pdf.groupby(["g", pdf["embedding"].map(len)], sort=False):
                for i in range(0, len(rows), BLOCK):
                    part = rows.iloc[i:i + BLOCK]
                    raw = stack(part["embedding"])
                    rotated = units(raw) @ rotation(dim, seed)
                    bits = rotated > 0
                    a = np.abs(rotated).sum(axis=1) / math.sqrt(dim)
                    yield pd.DataFrame({
                        "g": [g], "dim": [dim], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "raw": [raw.tobytes()],
                        "bits": [np.packbits(bits, axis=1).tobytes()], "scalars": [a.tobytes()]})

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    rows = vectors.select("vec_id", "embedding", spread.alias("g"))
    return rows.repartition(groups, "g").mapInPandas(
        pack, "g int, dim int, ids binary, raw binary, bits binary, scalars binary")


def _query_blocks(queries: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, rows in pdf.groupby(pdf["embedding"].map(len), sort=False):
                for i in range(0, len(rows), BLOCK):
                    part = rows.iloc[i:i + BLOCK]
                    yield pd.DataFrame({"q_dim": [dim], "q_ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                                        "q_raw": [stack(part["embedding"]).tobytes()]})

    return queries.select("vec_id", "embedding").mapInPandas(pack, "q_dim int, q_ids binary, q_raw binary")


def _nearest(k: int, eps: float, seed: int):
    """The k best of each index block for every query of a query block."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                dim = r.dim
                ids, raw = np.frombuffer(r.ids, np.int64), matrix(r.raw, dim, np.float64)
                a = np.frombuffer(r.scalars, np.float64)
                signs = np.unpackbits(matrix(r.bits, (dim + 7) // 8, np.uint8), axis=1, count=dim).astype(np.float32) * 2 - 1
                own = units(raw)
                width = eps * np.sqrt(np.maximum(1 - a * a, 0)) / a / math.sqrt(max(dim - 1, 1)) + 1e-6
                q_ids, q_own = np.frombuffer(r.q_ids, np.int64), units(matrix(r.q_raw, dim, np.float64))
                rotated = (q_own @ rotation(dim, seed)).astype(np.float32)
                for i in range(0, len(q_ids), 256):
                    est = (rotated[i:i + 256] @ signs.T) / (a * math.sqrt(dim)).astype(np.float32)
                    est[q_ids[i:i + 256, None] == ids[None, :]] = -np.inf  # the query's own row
                    low = est - width
                    floor = np.partition(low, max(len(ids) - k, 0), axis=1)[:, max(len(ids) - k, 0)]
                    for j in range(len(est)):
                        c = np.flatnonzero((est[j] + width >= floor[j]) & (est[j] > -np.inf))
                        score = np.clip((own[c] * q_own[i + j]).sum(axis=1), -1.0, 1.0)  # equal rows give equal sums, unlike a product of matrices
                        best = np.lexsort((ids[c], -score))[:k]
                        if len(best):
                            yield pd.DataFrame({"query_id": q_ids[i + j], "vec_id": ids[c][best], "score": score[best],
                                                "reranked": len(c)})
    return search


def _batched(search):
    """One output batch for each input batch: fewer, larger Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if found := list(search(iter([pdf]))):
                yield pd.concat(found, ignore_index=True)
    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, eps: float = EPS, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine for each row of
    ``queries``, its own vec_id excluded; ties go to the smaller vec_id.

    Both frames have vec_id and embedding. Vectors that are null, empty, zero or
    hold null or non-finite components take no part; vectors meet those of their
    own dimension. A vec_id on several rows is one candidate with its best
    score. Queries without candidates have no row.
    """
    spark = vectors.sparkSession
    groups = parallelism(spark)
    index = index_blocks(valid_vectors(vectors), groups, seed)
    asked = _query_blocks(valid_vectors(queries)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = (index.join(asked, (index["g"] == asked["g"]) & (index["dim"] == asked["q_dim"])).drop("g", "q_dim")
             .mapInPandas(_batched(_nearest(k, eps, seed)), "query_id long, vec_id long, score double, reranked int"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 50 = 0"), k=5)
