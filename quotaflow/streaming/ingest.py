"""Incremental ingest of revenue file drops with Structured Streaming.

Cleaning and enrichment are row-wise projections, so the very same
``clean`` / ``enrich`` run on a streaming DataFrame. New CSV (or Parquet)
files dropped into a folder are typed, cleaned and appended to a facts table
partitioned by ``month_label``; the views then read that table, with filters
pushed to the Parquet scan and month partitions pruned.

Progress is kept in a checkpoint folder on shared storage (by default under
the session's ``spark.checkpoint.dir``), so a restarted query, or one that
lost executors, resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quotaflow.operators.prep import prepare
from quotaflow.schema import REQUIRED_COLUMNS
from quotaflow.sources.revenue import DEFAULT_NA_VALUES, validate_schema

TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_COLUMNS])


def stream_revenue_files(spark: SparkSession, folder: str, fmt: str = "csv",
                         schema: T.StructType | None = None,
                         na_values: tuple[str, ...] = DEFAULT_NA_VALUES,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of cleaned, enriched facts from files arriving
    in ``folder``. CSV is read with a header and every column as text."""
    reader = spark.readStream.format(fmt)
    if fmt == "csv":
        # a file whose header differs from the schema fails the stream instead of swapping columns
        reader = reader.option("header", True).option("enforceSchema", False).option("escape", '"')
        schema = schema or TEXT_SCHEMA
    if schema is not None:
        reader = reader.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(folder)
    if fmt == "csv" and na_values:
        tokens = list(na_values)
        raw = raw.select([
            F.when(F.col(c).isin(tokens), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
            for c in raw.columns
        ])
    validate_schema(raw)
    return prepare(raw)


def default_checkpoint(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("no checkpoint folder: pass checkpoint_location or set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/quotaflow-streams/{name}"


def write_facts_stream(facts: DataFrame, path: str, checkpoint_location: str | None = None,
                       available_now: bool = True, query_name: str = "revenue_facts") -> StreamingQuery:
    """Append the streaming facts to a Parquet table partitioned by month.

    ``available_now=True`` processes every file present, then stops (a
    scheduled incremental batch); ``False`` keeps running.
    """
    spark = facts.sparkSession
    writer = (
        facts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint_location or default_checkpoint(spark, query_name))
        .partitionBy("month_label")
        .outputMode("append")
        .queryName(query_name)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def write_facts(facts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Batch sink: the cleaned facts as Parquet partitioned by ``month_label``
    (a table many views can share, with month pruning and pushed filters).
    Rows are gathered by month first, so that a month gives few files; adaptive
    execution splits a month that is too large for a task."""
    facts.hint("rebalance", "month_label").write.mode(mode).partitionBy("month_label").parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Read a facts table written by ``write_facts`` / ``write_facts_stream``;
    already clean, so no second cleaning pass is needed."""
    return spark.read.parquet(path)
