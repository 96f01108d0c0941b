from __future__ import annotations

import numpy as np

from quotaflow.llm.neardup_vectors import ORACLE_OP4, embedding_components, linked, op4_embedding_neardup, quantise
from quotaflow.llm.tiles import units
from helpers import SMALL, VECTORS, collected, oracle


def brute(rows, threshold=0.98):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    links = [set() for _ in rows]
    for i, (_, v, lab) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and ok[i] and ok[j] and lab == other and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
    least = [r[0] for r in rows]
    for _ in rows:
        for i, near in enumerate(links):
            least[i] = min([least[i], *(least[j] for j in near)])
    return sorted((r[0], len(links[i]), least[i], least[i] == r[0]) for i, r in enumerate(rows))


def test_query_against_sql(spark):
    want = sorted(tuple(r.values()) for r in oracle(ORACLE_OP4, SMALL, "embeddings"))
    assert sorted(map(tuple, op4_embedding_neardup(spark, SMALL).collect())) == want


def test_bounds_hold_and_only_close_pairs_are_recomputed():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((200, 48))
    b = np.concatenate([a[:100] + 0.2 * rng.standard_normal((100, 48)), rng.standard_normal((100, 48))])
    sure, unsure = linked(quantise(units(a)), quantise(units(b)), 48, 0.98)
    exact = units(a) @ units(b).T >= 0.98
    assert not (sure & ~exact).any() and not (exact & ~sure & ~unsure).any()
    assert exact.sum() and 0 < unsure.sum() < 200


def test_chains_copies_labels_and_invalid(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows, v = [], base.copy()
    for i in range(60):  # a chain whose ends are far apart
        rows.append((100 - i, [float(x) for x in np.float32(v)], 1))
        v = v + 0.1 * rng.standard_normal(16)
    rows += [(200 + i, [1.0, 2.0], 2) for i in range(30)] + [(300, [2.0, 4.0], 2), (301, [1.0, 2.0], 3), (302, [1.0, 2.0], None)]
    rows += [(400, None, 2), (401, [], 2), (402, [0.0, 0.0], 2), (403, [float("nan"), 1.0], 2), (404, [1.0, None], 2), (405, [1.0, 2.0, 0.0], 2)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS tile", "2 AS rep", "3 AS n")
    for tile in (7, 1024):
        assert sorted(map(tuple, embedding_components(df, tile=tile).collect())) == brute(rows)


def test_a_hot_group_around_the_threshold_over_many_tiles(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(24)
    rows = [(i, [float(x) for x in np.float32(base + 0.14 * rng.standard_normal(24))], 1) for i in range(150)]  # cosines on both sides of 0.98
    rows += [(1000 + i, rows[i][1], 1) for i in range(0, 150, 3)]
    want = brute(rows)
    assert 0 < np.mean([r[1] for r in want]) < 150
    for tile in (16, 1024):
        assert sorted(map(tuple, embedding_components(spark.createDataFrame(rows, VECTORS), tile=tile).collect())) == want


def test_clashing_columns_change_nothing(spark):
    rows = [(i, [1.0, 0.01 * i, 0.2], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, VECTORS)
    clash = df.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(["u", "v", "side", "dim", "b_tile", "tiles", "links", "component", "kept", "a.b"])])
    assert sorted(map(tuple, embedding_components(clash, tile=8).collect())) == sorted(map(tuple, embedding_components(df).collect())) == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], VECTORS)
    got = collected(embedding_components(df), "vec_id")
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert embedding_components(spark.createDataFrame([], VECTORS)).count() == 0
