from __future__ import annotations

import zlib
from collections import defaultdict

from quotaflow.llm import sharding
from quotaflow.llm.sharding import op2_sharding, shard_records
from helpers import DOCS, SMALL, documents


def check(rows, docs, shards=16):
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["law"] == "bytes" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - mean) <= 2 * max((r["size"] for r in rows), default=0) for s in range(shards))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = op2_sharding(spark, SMALL).collect()
    check(rows, docs)
    assert sorted(map(tuple, op2_sharding(spark, SMALL).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_hot_copies_long_texts_nulls_and_ranges(spark):
    texts = ["copy"] * 600 + [f"text {i}" * (i % 7) for i in range(300)] + ["x" * 20_000, None, None, ""]
    df = documents(spark, texts)
    for ranges in (1, 4, 64):
        check(shard_records(df, shards=16, ranges=ranges).collect(), list(enumerate(texts)))


def test_repeats_null_ids_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a", None, None, 1)] * 3 + [(5, "b", "x", "y", 2)] * 40, DOCS)
    df = df.selectExpr("*", "1 AS size", "'p' AS part", "2 AS shard", "3 AS h")
    check(shard_records(df, shards=4, ranges=8).collect(), [(None, "a")] * 3 + [(5, "b")] * 40, shards=4)
    assert shard_records(spark.createDataFrame([], DOCS)).count() == 0


def test_slices_inside_ranges(spark, monkeypatch):
    texts = ["copy"] * 200 + [f"text {i}" * (i % 9) for i in range(600)] + [None, "x" * 5_000]
    df = documents(spark, texts)
    whole = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_records(df, ranges=4).collect()}
    monkeypatch.setattr(sharding, "SLICE_BYTES", 700)  # 64 slices: most ranges have several
    sliced = shard_records(df, ranges=4).collect()
    check(sliced, list(enumerate(texts)))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sliced} == whole
