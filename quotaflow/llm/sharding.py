"""Sharding by sampled splitters.

Records are keyed by (text hash, doc_id): equal texts are neighbours, and a
large group of copies can still be divided by doc_id. A size-weighted sample of
the keys gives quantile boundaries; records are range-partitioned by them, and
a range that came out overfull (sampling error, one very long text) is
subdivided by boundaries drawn from a second sample inside it. The sampled ranges
are bounded in number, so they are cut into slices at even steps of the text hash,
which is uniform but for copies; the number of slices follows from the total.
Running sums over the slices then place every record, so shard sizes differ by about one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, text_bytes, written

#: Expected sampled keys for each range; the sample and the boundary lists that
#: reach the driver hold about ``ranges * SAMPLES_PER_RANGE`` keys.
SAMPLES_PER_RANGE = 24
#: Upper bound of the number of ranges of the first pass.
MAX_RANGES = 1024
#: Expected size of a slice in bytes (sizes as above): what one window task sums up.
SLICE_BYTES = 64 << 20
#: A range of more than this many times the mean is subdivided.
OVERFULL = 2.0


def _position(bounds: list[tuple[int, int]], key: Column) -> Column:
    """How many boundaries are <= key, by a two-level list: about 2 * sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]

    def literal(keys):
        return F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(d).cast("long").alias("d")) for h, d in keys])

    heads = literal([g[0] for g in groups])
    first = F.size(F.filter(heads, lambda b: b <= key))
    inner = F.element_at(F.array(*[literal(g) for g in groups]), F.greatest(first, F.lit(1)))
    return F.when(first == 0, 0).otherwise((first - 1) * step + F.size(F.filter(inner, lambda b: b <= key)))


def _splitters(keys: DataFrame, total: int, ranges: int, salt: int) -> list[tuple[int, int]]:
    """Quantile boundaries from a size-weighted sample of (h, d, size)."""
    want = ranges * SAMPLES_PER_RANGE
    draws = F.col("size") * F.lit(want / max(total, 1))  # expected draws of a key
    unit = F.pmod(F.xxhash64("h", "d", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = (keys.withColumn("w", F.floor(draws) + (unit < draws - F.floor(draws)).cast("long"))
              .where("w > 0").select("h", "d", "w").sort("h", "d").collect())
    weight, drawn = sum(r["w"] for r in picked), 0
    bounds: list[tuple[int, int]] = []
    for r in picked:
        if drawn * ranges >= weight * (len(bounds) + 1) and len(bounds) < ranges - 1:
            bounds.append((r["h"], r["d"]))
        drawn += r["w"]
    return sorted(set(bounds))


def shard_records(docs: DataFrame, shards: int = 16, ranges: int = 256) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) in a shard.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, range_no.
    Law ``bytes``: the shards' sizes (UTF-8 bytes + 1 a record) differ by about
    one record. Null texts count as empty, null ids as the smallest key.
    Repeated rows each get a slot. Shards without records do not occur.
    """
    if not 1 <= ranges <= MAX_RANGES:
        raise ValueError(f"ranges must be from 1 to {MAX_RANGES}")
    text = F.coalesce("text", F.lit(""))
    keyed = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("d"),
        (text_bytes("text") + 1).alias("size"), F.crc32(text).alias("text_crc32")), "shard-keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    key = F.struct("h", "d")
    first = _splitters(keyed, total, ranges, 1)
    placed = keyed.withColumn("part", _position(first, key).cast("int"))
    sizes = placed.groupBy("part").agg(F.sum("size").alias("bytes"))
    over = {r["part"]: r["bytes"] for r in sizes.where(F.col("bytes") > OVERFULL * total / ranges).collect()}
    if over:  # at most ranges / OVERFULL of them
        wide = placed.where(F.col("part").isin(list(over)))
        more = _splitters(wide, sum(over.values()), min(MAX_RANGES, int(OVERFULL * len(over) * 2) + 1), 2)
        placed = keyed.withColumn("part", _position(sorted(set(first + more)), key).cast("int"))
    # The records' order is by hash: its leading bits divide each range in that order.
    bits = max(0, -(-total // SLICE_BYTES) - 1).bit_length()
    placed = placed.withColumn("step", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    # Bytes and rows before each slice: at most one row a range and one for every SLICE_BYTES / 2.
    sums = W.orderBy("part", "step").rowsBetween(W.unboundedPreceding, -1)
    before = (placed.groupBy("part", "step").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
              .select("part", "step", F.coalesce(F.sum("bytes").over(sums), F.lit(0)).alias("bytes_before"),
                      F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("rows_before")))
    inside = W.partitionBy("part", "step").orderBy("h", "d", "size", "text_crc32")
    run = inside.rowsBetween(W.unboundedPreceding, -1)
    ranked = (placed.withColumn("lead", F.coalesce(F.sum("size").over(run), F.lit(0)))
              .withColumn("at", F.row_number().over(inside) - 1)
              .join(before, ["part", "step"])
              # the shard that the record's middle byte falls into
              .withColumn("shard", F.least(F.lit(shards - 1), F.floor(
                  (F.col("bytes_before") + F.col("lead") + F.col("size") / 2) * shards / F.lit(max(total, 1)))).cast("int"))
              .withColumn("rank", F.col("rows_before") + F.col("at")))
    starts = (ranked.groupBy("part", "shard").agg(F.min("rank").alias("rank"))
              .groupBy("shard").agg(F.min("rank").alias("start")))
    return ranked.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("part").alias("range_no"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))
