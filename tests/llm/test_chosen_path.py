from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quotaflow.llm import chosen_path as C
from quotaflow.llm.chosen_path import op10_chosen_path, shingles, similar_documents
from quotaflow.llm.common import connected_components
from helpers import DOCS, SMALL, documents


def plain_set(text, size=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    least = [d for d, _ in rows]
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    near = [{j for x in s for j in by_shingle[x]} for s in sets]
    links = [[j for j in near[i] if rows[i][0] is not None and rows[j][0] is not None
              and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(rows))]
    while True:
        nxt = [min([least[i], *(least[j] for j in links[i])]) if d is not None else None for i, (d, _) in enumerate(rows)]
        if nxt == least:
            return sorted(((d, len(sets[i]), least[i], d is None or least[i] == d) for i, (d, _) in enumerate(rows)), key=str)
        least = nxt


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
    return words


def near_copies(seed, groups=12, each=8, length=150):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        texts += [" ".join(edited(rng, base, rng.randrange(8))) for _ in range(rng.randrange(1, each))]
    rng.shuffle(texts)
    return texts


def run(spark, texts, **kw):
    return sorted(map(tuple, similar_documents(documents(spark, texts), **kw).collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_chosen_path(spark, SMALL).collect()), key=str) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = random.Random(9)
    texts = []
    for i in range(400):  # 100 shingles and 83 to 88 of them: just below and above the threshold
        base = [f"a{i}x{j}" for j in range(102)]
        texts += [" ".join(base), " ".join(base[:85 + rng.randrange(6)])]
    want = brute(list(enumerate(texts)))
    assert run(spark, texts) == want
    assert 200 < sum(not r[3] for r in want) < 330


@pytest.mark.parametrize("small", [4096, 6])
def test_groups_chains_and_deep_trees(spark, small):
    texts = near_copies(3)
    chain = [f"c{i}" for i in range(120)]
    for i in range(25):  # each links to the next, the ends share little
        texts.append(" ".join(chain))
        chain = [*chain[4:], *(f"n{i}x{j}" for j in range(4))]
    assert run(spark, texts, small=small) == brute(list(enumerate(texts)))


def test_hot_group_and_common_passage(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(edited(rng, base, 2)) for _ in range(250)] + [f"{passage} {' '.join(f'q{i}x{j}' for j in range(30))}" for i in range(250)]
    texts += [texts[0]] * 100
    assert run(spark, texts, small=64) == brute(list(enumerate(texts)))


def test_shingles():
    for text in ["", " \t", "One", "a b", "A b C", "a b c d", "É é É", "a\xa0b c\x0bd\x0ce", "x " * 500, "Thé " * 3 + "end"]:
        assert len(shingles(text)) == len(plain_set(text))
    assert (shingles("The CAT sat on") == shingles("the\ncat  sat ON")).all()
    assert not len(np.intersect1d(shingles("É b c"), shingles("é b c")))
    assert not len(np.intersect1d(shingles("a b"), shingles("a b a")))


def test_sketch_test_keeps_pairs_above_the_threshold():
    rng = np.random.default_rng(8)
    least, lost = C.least_agreement(85), 0
    for _ in range(300):
        s = rng.integers(1, 1 << 63, 1000, dtype=np.uint64)
        a, b = s[:920], s[80:]  # 840 of 1000
        ma, mb = (C.minwise(np.unique(x)) for x in (a, b))
        lost += int((ma[:C.SKETCH] == mb[:C.SKETCH]).sum()) < least
    assert lost == 0


def test_nulls_short_long_repeats_and_clashing_columns(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "two one"), (7, "word " * 200_000), (8, "word " * 100),
            (9, "a b c d e"), (9, "a b c d e"), (10, "x y z q"), (10, "completely other words here"), (11, "X y z Q"), (None, "a b c d e"), (None, None)]
    df = spark.createDataFrame([(d, t, "l", "s", 1) for d, t in rows], DOCS).selectExpr("*", "1 AS id", "2 AS n", "3 AS h", "4 AS component_id")
    assert sorted(map(tuple, similar_documents(df).collect()), key=str) == brute(rows)
    assert similar_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    want = {x: min(y for y in parent if find(y) == find(x)) for x in {x for e in edges if e[0] != e[1] for x in e}}
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["id"]: r["component"] for r in got.collect()} == want


def met(percent, depth, pairs=1500):
    """Share of pairs at exactly the similarity that meet in some tree at a depth."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (pairs, C.MINWISE), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < percent / 100, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    found = set()
    for tree in range(C.TREES):
        start = C._mix(np.full(pairs, tree, np.uint64) + C._ODD[7])
        one, two = (C._branch(start, np.arange(pairs), m, depth, C.second_branch(percent)) for m in (a, b))
        found |= {r for r, _ in set(zip(one[1].tolist(), one[0].tolist())) & set(zip(two[1].tolist(), two[0].tolist()))}
    return len(found) / pairs


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_by_depth_of_pairs_at_the_threshold(percent):
    assert met(percent, 3) > 0.998 and met(percent, 6) > 0.99 and met(percent, 9) > 0.98 and met(percent, 12) > 0.96


def test_branches_exceed_one_over_the_similarity():
    assert C.second_branch(85) == pytest.approx(0.25) and C.second_branch(100) == pytest.approx(C.SHARED - 1) and C.second_branch(1) == 1
    assert all((1 + C.second_branch(p)) * p / 100 > 1 for p in range(54, 101))
