"""Benchmark decontamination by winnowing.

A text's fingerprints are the least hashes of k words in every sliding window of so
many that a window spans ten words; equal spans of ten words choose the same hash,
wherever they stand. So a document that shares ten words with a benchmark item shares a
fingerprint with it:

1. Runs of windows with one fingerprint leave each document as (fingerprint, start,
   stop); those whose fingerprint no item has go.
2. What is left is extended to its whole windows and joined word by word with the
   distinct windows of all items.
3. Overlapping windows are united to hit words. Items are looked up once for every
   distinct set of windows, so that copies and common passages are joined once.

An item of fewer than ten words is one window; documents give the hashes of all their
spans of that length, for the lengths there are (nine at most).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Words, of a window and of a hashed gram.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, GRAM = 10, 5


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, even inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lowered(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def _words(text: str) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(WORD), F.lit(0))


def _spans(values: Column, length: int, of: Callable[..., Column]) -> Column:
    """``of`` the values of every span of ``length``, in order."""
    starts = F.slice(values, 1, F.greatest(F.size(values) - (length - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: of(x, *[F.get(values, i + j) for j in range(1, length)]))


def _record(fingerprint: Column, start: Column, stop: Column, length: int) -> Column:
    return F.struct(fingerprint.alias("fingerprint"), start.alias("start"), stop.alias("stop"), F.lit(length).alias("length"))


def _winnowed(hashes: Column) -> Column:
    """Records of the runs of windows that choose one fingerprint."""
    def runs(least: Column) -> Column:
        first = F.filter(F.transform(least, lambda x, i: F.when((i == 0) | (x != F.get(least, i - 1)), i)), lambda i: i.isNotNull())
        return _let(first, lambda at: F.transform(at, lambda i, n: _record(
            F.get(least, i), i, F.coalesce(F.get(at, n + 1), F.size(least)), WINDOW)))

    return _let(_spans(hashes, GRAM, F.xxhash64), lambda grams: _let(_spans(grams, WINDOW - GRAM + 1, F.least), runs))


def _records(words: Column, short: list[int]) -> Column:
    """Records of a text: its winnowed fingerprints and those of all spans of the ``short`` lengths."""
    def every(length: int, hashes: Column) -> Column:
        return F.transform(_spans(hashes, length, lambda *x: F.xxhash64(F.lit(length), *x)), lambda h, i: _record(h, i, i + 1, length))

    return _let(F.transform(words, lambda w: F.xxhash64(w)),
                lambda hashes: F.concat(_winnowed(hashes), *[every(n, hashes) for n in short]))


def item_windows(items: DataFrame) -> DataFrame:
    """(item, length, window): the distinct windows of ``items`` (item_id, text), words joined by one
    blank. A null item_id is the empty id; rows of one id are one item; items without words have none."""
    worded = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words("text").alias("words")).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(WINDOW))
    return worded.select("item", length.alias("length"), F.explode(F.transform(
        F.slice("words", F.lit(1), F.size("words") - length + 1), lambda w, i: F.array_join(F.slice("words", i + 1, length), " "))).alias("window")).distinct()


def find_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(text_md5, start, length, window): every window of ``items`` (item_id, text) in the distinct
    texts of ``docs`` (text), by the number of its first word."""
    sized = items.select(_words("text").alias("words"))
    short = sorted(r[0] for r in sized.select(F.size("words").alias("n")).where(f"n BETWEEN 1 AND {WINDOW - 1}").distinct().collect())
    whole = sized.where(f"size(words) >= {WINDOW}").select(F.inline(_records(F.col("words"), [])))
    parts = [sized.where(f"size(words) = {n}").select(F.inline(_records(F.col("words"), [n]))) for n in short]
    known = whole
    for part in parts:
        known = known.union(part)
    known = known.select("fingerprint", "length").distinct()
    texts = docs.select(F.md5(F.col("text").cast("string")).alias("text_md5"), "text")
    met = (texts.select("text_md5", F.inline(_records(_words("text"), short)))
           .join(known, ["fingerprint", "length"], "left_semi")
           .groupBy("text_md5").agg(F.collect_set(F.struct("start", "stop", "length")).alias("met")))
    met = written(met, "decontaminate-met")
    # The hits grow with the contaminated documents: never broadcast, whatever their size.
    extended = texts.join(met.hint("merge"), "text_md5").select("text_md5", "met", _words("text").alias("words")).select("text_md5", F.explode(_let(
        F.col("words"), lambda words: F.flatten(F.transform("met", lambda m: F.transform(
            F.sequence(m["start"], m["stop"] - 1),
            lambda i: F.struct(i.alias("start"), m["length"].alias("length"), F.array_join(F.slice(words, i + 1, m["length"]), " ").alias("window"))))))).alias("w"))
    return extended.select("text_md5", "w.*").distinct().join(item_windows(items).select("length", "window").distinct(), ["length", "window"], "left_semi")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs`` (doc_id, text).

    A word is hit if it lies inside a window of an item (item_id, text). Null and empty texts have no
    words and are clean; long texts are searched whole; repeated rows and rows of a null doc_id each
    give a row; without items or documents nothing is hit. Further columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hits = written(find_hits(docs, items).select("text_md5", "start", "length", F.md5("window").alias("window")), "decontaminate-hits")
    ends = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "length"))), F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["length"]).alias("upto"),
                              (a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(a["upto"], s["start"]), F.lit(0))).alias("n")))
    found = written(hits.groupBy("text_md5").agg(ends["n"].cast("long").alias("n_hit"), F.sort_array(F.collect_set("window")).alias("windows"))
                    .withColumn("windows_md5", F.md5(F.array_join("windows", ""))), "decontaminate-texts")
    sets = found.dropDuplicates(["windows_md5"]).select("windows_md5", F.explode("windows").alias("window"))
    of = item_windows(items).select("item", F.md5("window").alias("window")).distinct()
    named = (sets.join(of, "window").groupBy("windows_md5").agg(F.sort_array(F.collect_set("item")).alias("items"))
             .select("windows_md5", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    results = found.select("text_md5", "n_hit", "windows_md5").join(named, "windows_md5").drop("windows_md5")
    rows = docs.select("doc_id", F.md5("text").alias("text_md5"), F.regexp_count(_lowered("text"), F.lit(WORD)).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return rows.join(results, "text_md5", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every window of the items against every span of the documents, without fingerprints.
ORACLE_OP12 = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS length, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS row_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
spans AS (
  SELECT row_id, length, i, array_to_string(w[i:i + length - 1], ' ') AS win
  FROM (SELECT row_id, w, length, unnest(range(1, CAST(len(w) - length + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT length FROM windows))),
hits AS (SELECT DISTINCT row_id, i, s.length, item FROM spans s JOIN windows USING (length, win)),
words AS (SELECT row_id, count(DISTINCT j) AS n_hit FROM (SELECT row_id, unnest(range(i, i + length)) AS j FROM hits) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN named USING (row_id)
"""
