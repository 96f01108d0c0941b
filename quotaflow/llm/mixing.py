"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's permutation key is a seeded hash. The key's leading bits cut a
source into blocks in a random order, more of them the larger the source. A source's target gives whole passes over
its blocks and one partial pass: the blocks (then, inside the last block, ever
finer slices of the key) that come first in the permutation. A document that is
longer than the rest is passed over, and the pass goes on with those that fit. The taken blocks are
dealt to the output shards by a binary tree: at every node a seeded permutation
of all its blocks, whatever their source, is halved, so the left child's counts
by source are one multivariate-hypergeometric draw from the node's exact quotas.
Inside a shard, rows go by another seeded hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

#: Weights by the source's rank, repeated.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words; no source is taken more often than CAP times.
SHARE, CAP = 1.5, 2.0
#: Bits of the key that place a row in its source's permutation, by digits of these widths.
DIGITS = (5, 8, 8, 8)
PLACE_BITS = sum(DIGITS)
#: About so many blocks hold all sources; a source has a power of two, one at least.
BLOCKS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def _key(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")), F.lit(seed))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def _place() -> Column:
    return F.shiftrightunsigned("mix_key", 64 - PLACE_BITS)


def _digit(level: int) -> Column:
    return F.shiftright(_place(), sum(DIGITS[level + 1:])).bitwiseAND((1 << DIGITS[level]) - 1).cast("int")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to target words: SHARE of all words by weight, no
    source above CAP times its size, the excess shared by weight among the rest.
    Sources rank by code point, null last. The table has one row a source."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fill = W.orderBy("level", "rank")
    ranked = (sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("weight", w).withColumn("cap", F.col("source_size") * CAP)
              .withColumn("level", F.col("cap") / F.col("weight")))
    # The water level if exactly the sources before this one are full; its largest value is the true one.
    left = F.sum("source_size").over(every) * SHARE - F.coalesce(
        F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    water = left / F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    return (ranked.withColumn("water", water).withColumn("water", F.max("water").over(every))
            .withColumn("bits", F.coalesce(F.round(F.log2(F.greatest(
                F.try_divide(F.col("source_size") * BLOCKS, F.sum("source_size").over(every)), F.lit(1.0)))), F.lit(0)).cast("int"))
            .select("source", "source_size", F.least("cap", F.greatest(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"), "bits"))


def _pass(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` (cut_source, rest, low, most, ...) after the rows from place ``low`` on that have
    at most ``most`` words: ``high`` is the place of the first that does not fit into ``rest``
    (null if there are no rows), ``rest`` what those before it leave."""
    own = [c for c in cuts.columns if c != "rest"]
    fits = F.col("source").eqNullSafe(F.col("cut_source")) & (_place() >= F.col("low")) & (F.col("size") <= F.col("most"))
    for level in range(len(DIGITS)):
        inside = reduce(lambda a, k: a & (_digit(k) == F.col(f"cut{k}")), range(level), F.lit(True))
        sums = (rows.join(cuts.select("cut_source", "low", "most", *[f"cut{k}" for k in range(level)]), fits & inside)
                .groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("words")))
        upto = W.partitionBy("source").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "sum_source")
        end = cuts.join(sums, F.col("cut_source").eqNullSafe(F.col("sum_source")), "left")
        over = F.min(F.when(F.col("upto") > F.col("rest"), F.col("digit")))  # null at the first level: all fit
        kept = [*own, *[f"cut{k}" for k in range(level)], *(["some"] if level else [])]
        cuts = (end.groupBy(*kept, "rest").agg(F.coalesce(over, F.lit(0 if level else 1 << DIGITS[0])).alias(f"cut{level}"),
                                              F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("done"),
                                              *([] if level else [(F.count("digit") > 0).alias("some")]))
                .withColumn("rest", F.col("rest") - F.col("done")).drop("done"))
        cuts = written(cuts, "mix-cuts")
    place = sum((F.col(f"cut{k}").cast("long") * (1 << sum(DIGITS[k + 1:])) for k in range(len(DIGITS))), F.lit(0))
    return cuts.select(*own, "rest", F.when(F.col("some"), place).alias("high"))


def _cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a source: passes over all of it, and the pieces (places from low to below high,
    documents of at most so many words) of its partial pass, which ends before the place ``cut``.
    Every piece but the first starts behind a document that did not fit; what is left falls with each."""
    cuts = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumnRenamed("source", "cut_source") \
        .withColumns({"low": F.lit(0).cast("long"), "most": F.lit((1 << 63) - 1), "cut": F.lit(0).cast("long"),
                      "pieces": F.array().cast("array<struct<low:bigint,high:bigint,most:bigint>>")})
    rows = sized
    while True:
        piece = F.array(F.struct("low", "high", "most"))
        cuts = written(_pass(rows, cuts).select(
            "cut_source", "source_size", "target", "bits", "passes", "rest", F.coalesce("high", "cut").alias("cut"),
            F.when(F.col("high").isNull(), F.col("pieces")).otherwise(F.concat("pieces", piece)).alias("pieces"),
            F.coalesce(F.col("high") + 1, F.col("low")).alias("low"), F.floor("rest").cast("long").alias("most")), "mix-pieces")
        rows = sized.where("size > 0")
        if rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")) & (_place() >= F.col("low"))
                     & (F.col("size") <= F.col("most"))).isEmpty():
            return cuts.drop("rest", "low", "most")


def _tree(cuts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block) to the shards of its copies: first pass, second pass, ..."""
    blocks = cuts.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, bits) - 1"))))
    started = F.expr(f"shiftleft(cast(block AS bigint), {PLACE_BITS} - bits) < cut")
    copies = F.col("passes") + started.cast("int")
    quota = (blocks.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
             .select("cut_source", "block", "copy", F.lit(0).alias("low"), F.lit(shards).alias("high")))
    for level in range(max(shards - 1, 0).bit_length()):
        node = W.partitionBy("low", "high")
        drawn = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "cut_source", "block", "copy"), "cut_source", "block", "copy"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        share = F.round(F.count("*").over(node) * (middle - F.col("low")) / (F.col("high") - F.col("low")))
        quota = (quota.withColumn("drawn", drawn).withColumn("share", share).withColumn("middle", middle)
                 .withColumn("left", (F.col("drawn") <= F.col("share")) & (F.col("middle") > F.col("low")))
                 .withColumn("high", F.when(F.col("left"), F.col("middle")).otherwise(F.col("high")))
                 .withColumn("low", F.when(F.col("left"), F.col("low")).otherwise(F.col("middle")))
                 .drop("drawn", "share", "middle", "left"))
    return quota.groupBy(F.col("cut_source").alias("tree_source"), F.col("block").alias("tree_block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("copy", "low"))), lambda x: x["low"]).alias("tree_shards"))


def mix_plan(docs: DataFrame, shards: int = 16, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, cuts, tree): the narrow table of rows (doc_id, source, size,
    mix_key), each source's target and cut, each block's shards."""
    sized = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        _size(), _key(seed).alias("mix_key")), "mix-sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = _cuts(sized, written(source_targets(sizes), "mix-targets"))
    return sized, cuts, written(_tree(cuts, shards, seed), "mix-tree")


def with_times(rows: DataFrame, cuts: DataFrame, tree: DataFrame) -> DataFrame:
    """``rows`` (source, size, mix_key, ...) with source_size, target, times and shards."""
    own = rows.columns
    return (rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
            .withColumn("place", _place())
            .withColumn("started", F.expr("exists(pieces, p -> place >= p.low AND place < p.high AND size <= p.most)"))
            .withColumn("times", (F.col("passes") + F.col("started").cast("int")).cast("int"))
            .withColumn("mix_block", F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(mix_key, {64 - PLACE_BITS}), {PLACE_BITS} - bits) AS int)"))
            .join(tree, F.col("source").eqNullSafe(F.col("tree_source")) & (F.col("mix_block") == F.col("tree_block")), "left")
            .select(*own, "source_size", "target", "times",
                    F.slice(F.coalesce("tree_shards", F.array().cast("array<int>")), 1, F.col("times")).alias("shards")))


def mix_sources(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards: a row for every row of
    ``docs`` (doc_id, text, source). ``taken`` counts the words the mix takes of
    it, repeats included; ``shards`` has the output shard of each copy. Null
    texts count no words; exactly repeated rows are taken alike; a null doc_id is
    a value like any other. Reruns agree."""
    sized, cuts, tree = mix_plan(docs, shards, seed)
    return with_times(sized, cuts, tree).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "shards")


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their own columns, each as often
    as it is taken, grouped by output shard and shuffled inside it."""
    _, cuts, tree = mix_plan(docs, shards, seed)
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    own = [F.col(f"row.{q}").alias(c) for q, c in zip(names, docs.columns, strict=True)]
    held = docs.select(F.struct(*names).alias("row"), F.col("source").cast("string").alias("source"), _size(),
                       F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.lit(seed)).alias("mix_key"))
    dealt = (with_times(held, cuts, tree).select("row", "mix_key", F.posexplode("shards").alias("copy", "shard"))
             .withColumn("order", F.xxhash64("mix_key", "copy", F.lit(seed))))
    # A shard may be larger than a task: range partitions over (shard, order).
    return dealt.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select(*own)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
