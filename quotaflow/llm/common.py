"""Helpers shared by the training-data operators: table access, working tables
in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.session import ensure_checkpoint_dir

#: Salts of the star joins: a component's centre is spread over this many keys.
STAR_SALTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/quotaflow-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the
    lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_bytes(text: str | Column) -> Column:
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _with_min(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (u, v) joined with least (u, m), the hot u spread over salts."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(STAR_SALTS)))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(STAR_SALTS - 1)).cast("array<long>")))
    return salted.join(spread, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (_with_min(both, least).where("v > u AND v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = _with_min(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of ``edges``
    (u, v), by alternating large and small stars until the edges are stars.
    Ids without an edge are not listed."""
    def mark(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    edges = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = mark(edges)
    while before["n"]:
        nxt = written(_small_star(_large_star(edges)), "stars")
        remove(edges)
        edges, after = nxt, mark(nxt)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def give_back() -> None:
    """Memory that was freed goes back to the system: a Python worker that waits for its
    next task would keep it from its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives its memory back at its end."""
    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()
    return tidied
