from __future__ import annotations

import math
import re
import zlib

import numpy as np

from quotaflow.llm import langid as L
from quotaflow.llm.langid import fit_languages, grams, identify_languages, learn, learned_sample, op5_language_id
from helpers import DOCS, SMALL, collected, documents


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_of_the_query(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op5_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    mine = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(mine) > 150 and np.mean(mine) > 0.98


def plain_grams(text):
    clean = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    t = f" {clean} " if any(map(str.isalpha, clean)) else ""
    return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def unpacked(g):
    return {"".join(chr(c) for c in (int(x) >> 42, int(x) >> 21 & 0x1FFFFF, int(x) & 0x1FFFFF) if c) for x in g}


def test_ngrams_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["the cat", "The  CAT, 12!", "a", "é", "x\U0001F600y", "\U00010400\U00010428", "ab ab ab", " İi ", "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 20_000)))]
    for size in (1 << 20, 7):
        monkeypatch.setattr(L, "PACKED", size)
        for t in texts:
            g = grams(t)
            assert len(g) == len(set(g.tolist())) and unpacked(g) == plain_grams(t), t[:20]
    assert not len(grams("12 !")) and not len(grams(None))


def test_model_against_brute_force_kernel_ridge():
    rng = np.random.default_rng(4)
    words = {la: ["".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(60)] for la, letters in (("aa", "abcdeé"), ("bb", "cdefgh"), ("cc", "fghijk中"))}
    texts = [(" ".join(rng.choice(words[la], rng.integers(2, 40))), la) for la in list(words) * 70]
    model = learn([t for t, _ in texts], [la for _, la in texts])
    pieces = texts + [(" ".join(w[(k := i % (len(w) - L.FRAGMENT)):k + L.FRAGMENT]), la) for i, (t, la) in enumerate(texts) if len(w := t.split()) > L.FRAGMENT]
    marks = [t for la in words for t in [t for t, other in texts if other == la][:L.LANDMARKS // 3]]

    def k(many, few):
        a, b = [plain_grams(t) for t in many], [plain_grams(t) for t in few]
        return np.array([[len(x & y) / math.sqrt(len(x) * len(y)) if x else 0.0 for y in b] for x in a])

    # Ridge in its dual form: with a kernel from the pseudo-inverse of the landmarks', cosine-normalised, plus 1 for the bias.
    value, vector = np.linalg.eigh(k(marks, marks))
    inverse = sum(np.outer(v, v) / x for x, v in zip(value, vector.T, strict=True) if x > 1e-6 * value.max())

    def through(a, b):
        p, q = k(a, marks), k(b, marks)
        own = lambda m: np.sqrt(np.einsum("ij,jk,ik->i", m, inverse, m))
        return p @ inverse @ q.T / np.outer(own(p), own(q)) + 1

    of = [la for _, la in pieces]
    weight = np.array([1 / of.count(la) for la in of])
    weight *= len(of) / weight.sum()
    target = np.array([[float(la == name) for name in words] for la in of])
    ts = [t for t, _ in pieces]
    alpha = np.linalg.solve(through(ts, ts) + 3 * L.PENALTY * np.diag(1 / weight), target)
    asked = [" ".join(rng.choice(words[la], 5)) for la in list(words) * 10] + ["ijk abc", "a"]
    want = through(asked, ts) @ alpha
    values, _ = model.kernel(asked)
    assert np.allclose(values, k(asked, marks), atol=1e-6)
    assert np.allclose(model.features(values) @ model.weights, want, atol=1e-4)
    assert model.predict(asked)[0] == [list(words)[i] for i in want.argmax(axis=1)]


def test_the_greatest_output_wins_if_all_are_negative_and_ties_go_by_name():
    model = learn(["abc abd", "xyz xyw"], ["a", "b"])
    model.weights = np.zeros_like(model.weights)
    assert model.predict(["abc"])[0] == ["a"] and model.predict(["abc"])[1][0] == 0
    model.weights[-1] = [-2.0, -1.0]
    langs, scores = model.predict(["abc", ""])
    assert langs == ["b", "und"] and scores.tolist() == [0, 0]


def test_bounded_sample_ignores_held_out_rows_and_copies(spark):
    texts = [("copy of one text", "en", "s")] * 200 + [(f"text number {i} of many", "de" if i % 2 else "en", "s") for i in range(400)] + [("no label", None, "s")]
    df = documents(spark, texts)
    rows = learned_sample(df, per_language=30).collect()
    assert len(rows) == 60 and len({r["text"] for r in rows}) == 60
    allowed = {t for i, (t, _, _) in enumerate(texts) if not held(i)}
    assert {r["text"] for r in rows} <= allowed


def test_prediction_uses_the_text_alone(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = fit_languages(df)
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(df, model).collect()}
    other = df.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'yy' AS source")
    assert {r["doc_id"] - 1000000: (r["lang_pred"], r["score"]) for r in identify_languages(other, model).collect()} == plain


def test_undetermined_nulls_long_texts_and_clashing_columns(spark):
    texts = [None, "", " \n", "123 456 !?", "²", "_", "x", "the " * 50_000]
    train = documents(spark, [(f"the cat and dog {i}", "en", "s") for i in range(40)] + [(f"der hund und die katze {i}", "de", "s") for i in range(40)])
    model = fit_languages(train)
    df = documents(spark, texts).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS lang_found", "4 AS h", "5 AS `a.b`")
    got = collected(identify_languages(df, model), "doc_id")
    assert [r["lang_pred"] for r in got[:6]] == ["und"] * 6 and all(r["score"] == 0 for r in got[:6])
    assert got[6]["lang_pred"] in ("en", "de") and got[7]["lang_pred"] == "en" and got[7]["a.b"] == 5


def test_no_labels_one_language_and_empty(spark):
    nothing = fit_languages(documents(spark, [("some text", None, "s"), (None, "en", "s")]))
    assert nothing.langs == [] and nothing.predict(["some text"])[0] == ["und"]
    assert learn(["123"], ["en"]).langs == []
    one = learn(["a b c d e f g h i j k", "hello"], ["en", "en"])
    assert one.predict(["some text", None])[0] == ["en", "und"]
    empty = spark.createDataFrame([], DOCS)
    assert identify_languages(empty, fit_languages(empty)).count() == 0
