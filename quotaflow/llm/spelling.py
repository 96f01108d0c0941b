"""Spelling variants by search schemes over a bidirectional FM-index.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. Cut the searched word in two: one half is met unchanged. So there are two
searches, mirror images of each other: match the first half exactly and extend across
the second allowing one error; the same from the second half on the words read backwards.

The index holds the rotations of ``$word$word...$word`` in order, and those of that text
read backwards. A pattern is an interval of suffix ranks in each; a step to the left
narrows the first interval by the ranks of one symbol and shifts the second by the
number of smaller symbols there, a step to the right does the same with the two swapped.
The ranks come from a wavelet matrix, which also lists the symbols that occur in an
interval. ``$`` is the smallest symbol, so the rank of ``$word$`` is the word's place in
the sorted vocabulary.

Near words share their first three code points (or, in the mirrored search, their last
three). The vocabulary is dealt by these, each cell has an index of its own, and a cell
of more than ``CELL`` code points is cut into slices, each searched for every slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Runs of letters, one in how many loses a code point, and what makes a word.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGED, LEAST_LENGTH, LEAST_COUNT = 199, 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Code points at either end that near words share: half of the shortest word.
SHARED = LEAST_LENGTH // 2
#: Code points of a cell's index; words searched at a time.
CELL, BATCH = 1 << 18, 2048


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and how often they occur. A null
    text has none; a null doc_id counts as empty in the check sum."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    check = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (check % F.char_length("run")).cast("int")
    word = F.when(check % DAMAGED == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT))


def rotation_order(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a text in order, by doubling; no two rotations are equal."""
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * len(text) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == len(text) - 1:
            return order
        step *= 2


class Ranks:
    """A wavelet matrix over the symbols before the sorted rotations."""

    def __init__(self, text: np.ndarray, symbols: int):
        column = np.roll(text, 1)[rotation_order(text)]
        self.first = np.searchsorted(np.sort(column), np.arange(symbols))
        self.bits = max(symbols - 1, 1).bit_length()
        self.zeros = []
        for level in reversed(range(self.bits)):
            one = (column >> level & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            column = np.concatenate([column[~one], column[one]])
        every = np.arange(symbols)
        self.leaf = np.zeros(symbols, np.int64)
        self.leaf = self._descend(every * 0, every * 0, every)[0]

    def _descend(self, low, high, symbol):
        smaller = np.zeros(len(low), np.int64)
        for level, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            one = (symbol >> level & 1).astype(bool)
            z_low, z_high = zeros[low], zeros[high]
            smaller += np.where(one, z_high - z_low, 0)
            low = np.where(one, zeros[-1] + low - z_low, z_low)
            high = np.where(one, zeros[-1] + high - z_high, z_high)
        return low, high, smaller

    def step(self, low, size, symbol):
        """Interval (low, size) before one symbol each, and how many smaller symbols were there."""
        a, b, smaller = self._descend(low, low + size, symbol)
        return self.first[symbol] + a - self.leaf[symbol], b - a, smaller

    def steps(self, low, size):
        """The same for all symbols that occur: (number of the interval, symbol, low, size, smaller)."""
        high, of = low + size, np.arange(len(low))
        symbol, smaller = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for zeros in self.zeros:
            z_low, z_high = zeros[low], zeros[high]
            of, symbol = np.concatenate([of, of]), np.concatenate([symbol * 2, symbol * 2 + 1])
            smaller = np.concatenate([smaller, smaller + z_high - z_low])
            low, high = np.concatenate([z_low, zeros[-1] + low - z_low]), np.concatenate([z_high, zeros[-1] + high - z_high])
            some = high > low
            of, symbol, smaller, low, high = of[some], symbol[some], smaller[some], low[some], high[some]
        return of, symbol, self.first[symbol] + low - self.leaf[symbol], high - low, smaller


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row and where each word starts."""
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), starts


class Vocabulary:
    """A bidirectional index over distinct words; word numbers are places in sorted order."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        flat, starts = code_points(self.words)
        self.alphabet = np.unique(flat)
        text = np.zeros(len(flat) + len(words), np.int64)  # 0 is the delimiter before each word
        text[np.arange(len(flat)) + np.repeat(np.arange(1, len(words) + 1), np.diff(starts))] = np.searchsorted(self.alphabet, flat) + 1
        symbols = len(self.alphabet) + 1
        self.size = len(text)
        self.before, self.after = Ranks(text, symbols), Ranks(text[::-1], symbols)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols, -1 where no indexed word has one, and where each starts."""
        flat, starts = code_points(words)
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == flat, at + 1, -1), starts

    def near(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``words``, number of an indexed word) for all near pairs whose error is behind
        the first ``halves`` code points; each pair once."""
        flat, starts = self.symbols(words)
        length = np.diff(starts)
        # The first half from its last code point to its first, then the delimiter before it.
        of, left, right = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size = np.full(len(words), self.size)
        whole: list[tuple] = []
        for t in range(int(halves.max(initial=0)) + 1):
            ended = t == halves[of]
            symbol = np.where(ended, 0, flat[np.minimum(starts[of] + np.maximum(halves[of] - 1 - t, 0), len(flat) - 1)])
            of, left, right, size, symbol, ended = (x[symbol >= 0] for x in (of, left, right, size, symbol, ended))
            left, size, smaller = self.before.step(left, size, symbol)
            right = right + smaller
            some = (size > 0) & ended
            whole.append(tuple(x[some] for x in (of, left, right, size)))
            of, left, right, size = (x[(size > 0) & ~ended] for x in (of, left, right, size))
        of, left, right, size = (np.concatenate(x) for x in zip(*whole, strict=True))
        exact = (of, halves[of], left, right, size)
        wrong = tuple(x[:0] for x in exact)
        found_of, found = [], []
        while len(exact[0]) or len(wrong[0]):
            # One error so far: only the word's own symbols, then the delimiter behind it.
            of, at, left, right, size = wrong
            ended = at == length[of]
            symbol = np.where(ended, 0, flat[np.minimum(starts[of] + at, len(flat) - 1)])
            known = symbol >= 0
            of, at, left, ended = of[known], at[known], left[known], ended[known]
            right, size, smaller = self.after.step(right[known], size[known], symbol[known])
            left = left + smaller
            done, on = (size > 0) & ended, (size > 0) & ~ended
            found_of.append(of[done])
            found.append(left[done])
            wrong = [(of[on], at[on] + 1, left[on], right[on], size[on])]
            # No error so far: every symbol that occurs there.
            of, at, left, right, size = exact
            inside = at < length[of]
            here = np.where(inside, flat[np.minimum(starts[of] + at, len(flat) - 1)], 0)
            following = np.where(at + 1 < length[of], flat[np.minimum(starts[of] + at + 1, len(flat) - 1)], 0)
            drop = inside & (here != following)  # of a run of one symbol only the last is deleted
            wrong.append((of[drop], at[drop] + 1, left[drop], right[drop], size[drop]))
            i, symbol, r, s, smaller = self.after.steps(right, size)
            grown = (of[i], at[i], left[i] + smaller, r, s)
            same, letter = symbol == here[i], symbol > 0
            replaced = letter & ~same & inside[i]
            wrong.append((grown[0][replaced], grown[1][replaced] + 1, *(x[replaced] for x in grown[2:])))
            added = letter & ~same  # before an equal symbol: the same word as behind it
            wrong.append(tuple(x[added] for x in grown))
            kept = same & letter
            exact = (grown[0][kept], grown[1][kept] + 1, *(x[kept] for x in grown[2:]))
            wrong = tuple(np.concatenate(x) for x in zip(*wrong, strict=True))
        return np.concatenate(found_of or [of[:0]]), np.concatenate(found or [of[:0]])


def _cells(words: DataFrame) -> DataFrame:
    """Rows (mirrored, cell, i, j, word, n, indexed, searched): the group (cell, i, j) searches slice j's
    words in the index of slice i. A cell of at most CELL code points is one slice; small cells share a group."""
    ends = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(False).alias("mirrored"), F.substring("word", 1, SHARED).alias("key")),
        F.struct(F.lit(True).alias("mirrored"), F.expr(f"right(word, {SHARED})").alias("key")))).alias("e")).select("word", "n", "e.*")
    sizes = ends.groupBy("mirrored", "key").agg(F.ceil(F.sum(F.char_length("word") + 1) / CELL).cast("int").alias("slices"))
    total = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    shared = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // CELL))))
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    return (ends.join(sizes, ["mirrored", "key"]).withColumn("own", own)
            .withColumn("cell", F.when(F.col("slices") > 1, F.col("key")).otherwise(shared.cast("string")))
            .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            .withColumn("g", F.explode(F.when(F.col("t") == F.col("own"), F.array(
                F.struct(F.col("own").alias("i"), F.col("own").alias("j"), F.lit(True).alias("indexed"), F.lit(True).alias("searched")))).otherwise(F.array(
                    F.struct(F.col("own").alias("i"), F.col("t").alias("j"), F.lit(True).alias("indexed"), F.lit(False).alias("searched")),
                    F.struct(F.col("t").alias("i"), F.col("own").alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("searched"))))))
            .select("mirrored", "cell", "word", "n", "g.*"))


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """Of one group: (word, near_word, near_n, n_near), the most frequent near word found and their number."""
    mirrored = bool(group["mirrored"].iloc[0])
    turn = (lambda w: w[::-1]) if mirrored else (lambda w: w)
    held, asked = group[group["indexed"]], group[group["searched"]]
    counts = {turn(w): n for w, n in zip(held["word"], held["n"], strict=True)}
    out: list[tuple] = []
    if counts:
        index = Vocabulary(list(counts))
        n = np.array([counts[w] for w in index.words])
        place = np.empty(len(n), np.int64)  # in the order of the words read forwards
        place[np.argsort(np.array([turn(w) for w in index.words], object), kind="stable")] = np.arange(len(n))
        for at in range(0, len(asked), BATCH):
            words = [turn(w) for w in asked["word"].iloc[at:at + BATCH]]
            first = np.array([len(w) - len(w) // 2 if mirrored else len(w) // 2 for w in words])
            of, found = index.near(words, first)
            if mirrored:  # a near word with the same first half was found from there
                rest = np.array([not index.words[f].endswith(words[o][first[o]:]) for o, f in zip(of, found, strict=True)], bool)
                of, found = of[rest], found[rest]
            order = np.lexsort((place[found], -n[found], of))
            of, found = of[order], found[order]
            some, start, number = np.unique(of, return_index=True, return_counts=True)
            out += [(turn(words[o]), turn(index.words[f]), n[f], k) for o, f, k in zip(some, found[start], number, strict=True)]
    return pd.DataFrame(out, columns=["word", "near_word", "near_n", "n_near"])


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n), which are distinct,
    not null and have at least six code points each.

    ``form`` is the near word with the largest n (of equal ones the smallest in code-point order) if
    that is at least RATIO times the word's; ``root`` is the end of the chain of forms. Words of any
    length are searched whole; an empty table gives none; further columns are ignored.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    found = (_cells(words).groupBy("mirrored", "cell", "i", "j")
             .applyInPandas(_search, "word string, near_word string, near_n long, n_near long")
             .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near_word")).alias("best")))
    form = -F.col("best.less") >= RATIO * F.col("n")
    links = written(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form, F.col("best.near_word")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")), "spelling-links")
    # n grows RATIO times with each form, so a chain has few; each join doubles what is followed.
    roots = links.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    hops = math.log(links.agg(F.max("n")).first()[0] or 1, RATIO)
    for _ in range(math.ceil(math.log2(hops + 1))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return links.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(written(word_counts(table(spark, sf_dir, "documents")), "spelling-words"))
