from __future__ import annotations

import numpy as np

from quotaflow.llm.ann import index_blocks, nearest_neighbours, op3_nearest_neighbours
from quotaflow.llm.tiles import valid_vectors
from helpers import SMALL, VECTORS, collected


def brute(rows, queries, k=5):
    m = np.array([v for _, v in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i in queries:
        s = m @ m[list(ids).index(i)]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
        out[i] = [(ids[j], s[j]) for j in order]
    return out


def test_recall_and_scores_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    got = {}
    for r in collected(op3_nearest_neighbours(spark, SMALL), "query_id", "rank"):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in want[q]} & {v for v, _, _ in got[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    exact = {(q, v): s for q in want for v, s in want[q]}
    for q, found in got.items():
        assert [x[2] for x in found] == list(range(1, len(found) + 1))
        assert all(abs(exact.get((q, v), s) - s) < 1e-12 for v, s, _ in found)


def test_every_valid_row_is_indexed(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    blocks = index_blocks(valid_vectors(df), 5).collect()
    assert sorted(i for b in blocks for i in np.frombuffer(b["ids"], np.int64)) == sorted(r["vec_id"] for r in df.collect())


def test_invalid_vectors_ties_and_few_candidates(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one, 0) for i in range(8)] + [(8, None, 0), (9, [], 1), (10, [0.0, 0.0, 0.0], 1), (11, [1.0, None, 0.0], 1),
            (12, [float("nan"), 1.0, 0.0], 1), (13, [float("inf"), 1.0, 0.0], 1), (None, one, 1), (14, [1.0, 2.0], None), (0, one, 0)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS g", "2 AS dim", "3 AS score")
    got = collected(nearest_neighbours(df, df.where("vec_id IN (0, 7, 8, 14)"), k=3), "query_id", "rank")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (7, 1, 0), (7, 2, 1), (7, 3, 2)]
    assert all(r["score"] == 1.0 for r in got)
    assert nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_equal_random_vectors_rank_by_id_inside_and_across_blocks(spark, monkeypatch):
    from quotaflow.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(30):
        v = rng.standard_normal(48).astype(np.float32).tolist()
        ids = rng.permutation(np.arange(g * 50, g * 50 + 9)).tolist()
        rows += [(int(i), v, 0) for i in ids]
        for q in (g * 50, g * 50 + 4):
            want[q] = [i for i in sorted(ids) if i != q][:5]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), list(map(float, v)), int(x)) for i, v, x in rows], VECTORS)
    got = {}
    for r in collected(nearest_neighbours(df, df.where("vec_id % 50 IN (0, 4)")), "query_id", "rank"):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want
