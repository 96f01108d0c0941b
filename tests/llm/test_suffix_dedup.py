from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quotaflow.llm import suffix_dedup as S
from quotaflow.llm.suffix_dedup import Family, anchors, op8_suffix_dedup, remove_repeats, union
from helpers import DOCS, SMALL, collected, documents


def brute(docs):
    """(n_bytes, n_removed, n_spans, kept bytes) of each (doc_id, text)."""
    first = {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            if d is not None:
                first[raw[i:i + 50]] = min(first.get(raw[i:i + 50], d), d)
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def got(df):
    rows = [(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["starts"]), bytes(r["kept"])) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def corpus(seed, n, letters="abé d\n"):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
    shared = ["".join(word() for _ in range(8)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared)[rng.randint(0, 40):rng.randint(45, 150)] if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 12))]
        texts.append("".join(parts))
    return texts


def test_random_corpora_against_brute_force(spark):
    for seed, n in ((1, 60), (2, 60), (3, 200)):
        texts = corpus(seed, n)
        ids = random.Random(seed).sample(range(1000), n)
        df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)
        assert got(remove_repeats(df)) == brute(list(zip(ids, texts, strict=True)))


def test_small_flushes_and_many_levels(spark, monkeypatch):
    texts = corpus(7, 150)
    monkeypatch.setattr(S, "FLUSH", 1500)
    monkeypatch.setattr(S, "CHUNK", 400)
    monkeypatch.setattr(S, "BATCH", 16)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    pdf = S.pd.DataFrame([(d, t) for d, t in rows if t], columns=["doc_id", "text"])
    batches = lambda df: iter([S.pa.RecordBatch.from_pandas(df, preserve_index=False)])
    parts = S.pd.concat([b.to_pandas() for b in S._index_rows(4)(batches(pdf))])
    hits = {}
    for _, group in parts.groupby("part"):
        for r in S._scan_range(group).itertuples():
            hits.setdefault(r.doc_id, []).append(r.keys)
    assert len(parts) > 40
    touched = pdf[pdf["doc_id"].isin(hits)].assign(rid=lambda p: p["doc_id"] * 3, keys=lambda p: [hits[d] for d in p["doc_id"]])
    windows = S.pd.concat([b.to_pandas() for b in S._window_rows(4)(batches(touched))])
    spans = {}
    for _, group in windows.groupby("part"):
        for r in S._match_range(group).itertuples():
            assert r.rid == r.doc_id * 3
            spans.setdefault(r.doc_id, []).append(np.frombuffer(r.spans, np.int64).reshape(-1, 2))
    for d, n_bytes, removed, runs, _ in brute(rows):
        mine = union(np.concatenate(spans.get(d, [np.zeros((0, 2), np.int64)])))
        assert (len(mine), int((mine[:, 1] - mine[:, 0]).sum())) == (runs, removed)


def test_equal_windows_choose_equal_anchors():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 101, 50, dtype=np.uint8)
    for _ in range(200):
        bufs = [np.concatenate([rng.integers(97, 101, rng.integers(0, 80), dtype=np.uint8), passage,
                                rng.integers(97, 101, rng.integers(0, 80), dtype=np.uint8)]) for _ in range(2)]
        keys = [set(anchors(b, np.array([len(b)]))[4].tolist()) for b in bufs]
        assert keys[0] & keys[1]


def test_family_flags_both_sides_once():
    rng = np.random.default_rng(4)
    family, seen = Family(), {}
    for batch in range(40):
        keys = np.unique(rng.integers(0, 900, 50, dtype=np.uint32))
        docs = batch * 100 + rng.integers(0, 50, len(keys))
        for k, d in zip(keys, docs, strict=True):
            seen.setdefault(int(k), set()).add(int(d))
        family.add(keys, docs)
    assert len(family.levels) < 12
    keys, docs = family.found()
    want = {(k, d) for k, ds in seen.items() if len(ds) > 1 for d in ds}
    assert set(zip(keys.tolist(), docs.tolist(), strict=True)) == want and len(keys) == len(want)


def contexts(rng, n):
    """Contexts of anchors with few different bytes: (doc, back, bytes)."""
    rows = []
    for _ in range(n):
        left, right = rng.randint(0, 30), rng.randint(20, 50)
        if left + right >= 50:
            left_bytes, right_bytes = (bytes(rng.choice(b"\0a") if i == rng.randint(0, m) else 97 for i in range(m)) for m in (left, right))
            rows.append((rng.randint(0, 40), left, left_bytes + right_bytes))
    return rows


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_suffix_family_against_brute_force(batch):
    rows = contexts(random.Random(batch), 400)
    first = {}
    for doc, back, raw in rows:
        for w in range(len(raw) - 49):
            same = (back - w, raw[w:w + 50])
            first[same] = min(first.get(same, doc), doc)
    sizes = np.array([len(r[2]) for r in rows])
    family = S.SuffixFamily(np.frombuffer(b"".join(r[2] for r in rows), np.uint8), np.cumsum(sizes) - sizes, sizes,
                            np.array([r[1] for r in rows]), np.zeros(len(rows), np.uint32), np.array([r[0] for r in rows]))
    for a in range(0, len(rows), batch):
        family.add(np.arange(a, min(a + batch, len(rows))))
    for i, (doc, back, raw) in enumerate(rows):
        want = [int(first[back - w, raw[w:w + 50]] < doc) for w in range(len(raw) - 49)]
        assert family.gone[i, 1:len(want) + 1].tolist() == want and not family.gone[i, len(want) + 1:].any()
    assert family.gone.any() and len(family.levels) < 10
    for level in family.levels:
        suffixes = family.right[level].tolist()
        assert suffixes == sorted(suffixes)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, m, k, hashlib.sha256(kept).hexdigest()) for d, n, m, k, kept in brute(docs)]
    assert [tuple(r.values()) for r in collected(op8_suffix_dedup(spark, SMALL), "doc_id")] == want


def test_periodic_long_copies_nulls_repeats_and_clashing_columns(spark):
    period = "thhaen " * 300
    texts = [period, "x" * 49, "x" * 49, "x" * 50, "x" * 50, "x" * 120, None, "", None, period + "end", "lead" + period, "y" * 3_000_000, "z" + "y" * 200]
    rows = [*enumerate(texts), (3, "x" * 50), (4, "other " * 20), (4, "other " * 20), (None, "x" * 80), (None, None)]
    df = spark.createDataFrame([(d, t, "l", "s", 1) for d, t in rows], DOCS).selectExpr("*", "1 AS keys", "2 AS rid", "3 AS spans", "4 AS `a.b`", "5 AS sha")
    out = remove_repeats(df, keep=("lang", "rid", "spans", "a.b", "sha"))
    quick = [r for r in brute([r for r in rows if not r[1] or len(r[1]) < 10_000] + [(11, "y" * 300)])]
    mine = [r if r[0] != 11 else (11, 300, r[2], r[3], b"y" * 300) for r in got(out)]
    assert mine == quick
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_whole_characters_stay(spark):
    a, b = "é" * 30, "è" * 5 + "é" * 30  # their last and first bytes agree beyond the characters
    df = documents(spark, [a + "1", "x" + b, "\xa9" + a])
    for r in remove_repeats(df, characters=True).collect():
        assert bytes(r["kept"]).decode() in (a + "1", "x" + "è" * 5, "\xa9")
