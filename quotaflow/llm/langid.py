"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the distinct
character n-grams (n = 1, 2, 3) that both hold, over the geometric mean of their
numbers. A Nystroem map through landmark texts gives finite features, on which
one-versus-rest kernel ridge regression is fitted. An n-gram is a 63-bit number, no
hash, so the kernel is exact: only n-grams of the landmarks can be shared with one, a
batch of texts is a 0/1 matrix over these, and all its kernel values are one matrix
product over the roots of the texts' own numbers of n-grams.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: Landmark texts in all; texts learned from for each language (the bound of the sample).
LANDMARKS, LEARN = 160, 300
#: Ridge penalty; words of the fragment that each learned text also gives.
PENALTY, FRAGMENT = 1e-2, 8
#: Cells of the 0/1 matrix of a product (texts x n-grams of the landmarks); characters packed at a time.
CELLS, PACKED = 1 << 22, 1 << 20
UNDETERMINED = "und"

_GAP = re.compile(r"[\W\d_]+")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2, F.lit(False))


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]]


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of a whole text, each as its three code points (the
    missing ones 0) in 21 bits each; none without a letter."""
    clean = _GAP.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, clean)):
        return np.zeros(0, np.uint64)
    points = np.frombuffer(f" {clean.strip()} ".encode("utf-32-le"), np.uint32)
    packs = []
    for i in range(0, len(points) - 2, PACKED):
        c = points[i:i + PACKED + 2].astype(np.uint64)
        packs.append(np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]))
    three = packs[0] if len(packs) == 1 else np.unique(np.concatenate(packs))
    # Shorter n-grams begin a longer one, but for the last two characters; the last is a blank, as is the first.
    last = (int(points[-2]) << 42) | (int(points[-1]) << 21)
    two = np.unique(np.append(_distinct(three >> np.uint64(21) << np.uint64(21)), np.uint64(last)))
    return np.concatenate([_distinct(two >> np.uint64(42) << np.uint64(42)), two, three])


def presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """0/1 rows: which n-grams of the (sorted) vocabulary each set holds."""
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, g in zip(out, sets, strict=True):
        at = np.minimum(np.searchsorted(vocabulary, g), max(len(vocabulary) - 1, 0))
        row[at[vocabulary[at] == g]] = 1
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    vocabulary: np.ndarray  # the landmarks' n-grams, sorted
    landmarks: np.ndarray  # 0/1 rows over them, as bits
    sizes: np.ndarray  # of the landmarks
    whiten: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The kernel of each text with each landmark, and the texts' numbers of n-grams."""
        marks = np.unpackbits(self.landmarks, axis=1, count=len(self.vocabulary)).astype(np.float32).T
        values, sizes = np.zeros((len(texts), len(self.sizes))), np.zeros(len(texts))
        step = max(1, CELLS // max(1, len(self.vocabulary)))
        for i in range(0, len(texts), step):
            sets = [grams(t) for t in texts[i:i + step]]
            sizes[i:i + step] = n = np.array([len(g) for g in sets], float)
            values[i:i + step] = (presence(sets, self.vocabulary) @ marks) / np.sqrt(np.outer(np.maximum(n, 1), self.sizes))
        return values, sizes

    def features(self, values: np.ndarray) -> np.ndarray:
        f = values @ self.whiten
        length = np.sqrt((f * f).sum(axis=1, keepdims=True))
        f = np.divide(f, length, out=np.zeros_like(f), where=length > 0)
        return np.hstack([f, np.ones((len(f), 1))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of the greatest regression output (ties: the first in code-point order)
        and score (that output over the sum of the positive ones, 0 if none is positive)."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        values, sizes = self.kernel(texts)
        out = self.features(values) @ self.weights
        best, total = out.argmax(axis=1), np.maximum(out, 0).sum(axis=1)
        share = np.divide(out.max(axis=1, initial=0), total, out=np.zeros(len(out)), where=total > 0)
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, share, 0.0)


def learn(texts: list[str], langs: list[str]) -> LanguageModel:
    """Fit on texts in a fixed order; landmarks are spread evenly over the languages."""
    pieces = [(t, la) for t, la in zip(texts, langs, strict=True)]
    pieces += [(" ".join(w[(k := i % (len(w) - FRAGMENT)):k + FRAGMENT]), la)
               for i, (t, la) in enumerate(pieces) if len(w := t.split()) > FRAGMENT]
    pieces = [(t, la) for t, la in pieces if any(map(str.isalpha, t))]
    names = sorted({la for _, la in pieces})
    if not names:
        none = np.zeros((0, 0))
        return LanguageModel([], np.zeros(0, np.uint64), none.astype(np.uint8), np.zeros(0), none, none)
    each = max(1, LANDMARKS // len(names))
    marks = [t for n in names for t in [t for t, la in pieces if la == n][:each]]
    sets = [grams(t) for t in marks]
    vocabulary = np.unique(np.concatenate(sets))
    model = LanguageModel(names, vocabulary, np.stack([np.packbits(presence([g], vocabulary)[0] > 0) for g in sets]),
                          np.array([len(g) for g in sets], float), np.zeros((0, 0)), np.zeros((0, 0)))
    value, vector = np.linalg.eigh(model.kernel(marks)[0])
    solid = value > 1e-6 * value.max()
    model.whiten = vector[:, solid] / np.sqrt(value[solid])
    f = model.features(model.kernel([t for t, _ in pieces])[0])
    labels = [la for _, la in pieces]
    target = (np.array(labels)[:, None] == np.array(names)[None, :]).astype(float)
    number = Counter(labels)
    weight = 1 / np.array([number[la] for la in labels])  # languages count alike
    weight *= len(labels) / weight.sum()
    gram = (f * weight[:, None]).T @ f + PENALTY * len(names) * np.eye(f.shape[1])
    model.weights = np.linalg.solve(gram, (f * weight[:, None]).T @ target)
    return model


def learned_sample(docs: DataFrame, per_language: int = LEARN) -> DataFrame:
    """text, lang: up to ``per_language`` different labelled texts of each language,
    drawn by text hash from the documents that are not held out."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("doc_id", "lang", "text")
    first = labelled.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    drawn = (first.withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id")))
             .where(F.col("i") <= per_language).select("lang", "doc_id"))
    # A few rows a language: small enough to broadcast whatever the corpus holds.
    return labelled.join(F.broadcast(drawn), ["lang", "doc_id"]).select("text", "lang").distinct()


def fit_languages(docs: DataFrame, per_language: int = LEARN) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang); the sample, at most ``per_language``
    texts of each language, is the only thing that reaches the driver."""
    rows = sorted(tuple(r) for r in learned_sample(docs, per_language).collect())
    order = np.random.default_rng(11).permutation(len(rows))
    return learn([rows[i][0] for i in order], [rows[i][1] for i in order])


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score for every whole text.
    Null texts, texts without a letter, and a model without languages give ``und`` and 0; an
    empty table gives no rows. Very long texts are read whole, about a million characters at a
    time, and must fit in a task. Columns lang_pred and score of ``docs`` are replaced."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            langs, scores = model.predict(t.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores})

    predict = F.pandas_udf(run, "lang string, score double")
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.withColumn("lang_found", predict(F.col("text").cast("string")))
    return found.select(*names, F.col("lang_found.lang").alias("lang_pred"), F.col("lang_found.score").alias("score"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
