"""Churn impact (A13) and forecast-confidence calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.functions import (
    CONFIDENCE_LABELS,
    confidence_bucket_id,
    confidence_bucket_label,
    guarded_ratio,
    round_half_even,
)
from quotaflow.functions.states import KNOWN, RECORDS, REST, ROWS, are_states, mean, records, total


def churn_impact(df: DataFrame) -> DataFrame:
    """Gross revenue parts, churn, net revenue and churn rate by region,
    churn desc."""
    return (
        df.groupBy("region")
        .agg(
            total(df, "monthly_recurring_revenue_eur").alias("gross_revenue"),
            total(df, "expansion_revenue_eur").alias("expansion"),
            total(df, "renewal_revenue_eur").alias("renewal"),
            total(df, "churned_revenue_eur").alias("churn"),
        )
        .withColumn("gross_total", F.col("gross_revenue") + F.col("expansion") + F.col("renewal"))
        .withColumn("net_revenue", F.col("gross_total") - F.col("churn"))
        .withColumn("churn_rate_pct", round_half_even(guarded_ratio("churn", "gross_total", scale=100.0), 2))
        .orderBy(F.desc("churn"), "region")
    )


def forecast_confidence(df: DataFrame) -> DataFrame:
    """Records, forecast and actual revenue, mean confidence and the
    actual/forecast ratio per confidence bucket.

    All four buckets are always present (an empty one has 0 records, sums 0.0,
    mean NULL, ratio 0.0); scores outside [0, 1.0001] form a NULL bucket,
    sorted last. The empty buckets come from four placeholder rows added
    before the one aggregation, so no join is needed.
    """
    spark = df.sparkSession
    amounts = ("forecasted_revenue_next_quarter", "total_revenue_eur", "forecast_confidence_score")
    if are_states(df):
        bucketed = df.select("bucket_id", ROWS, RECORDS, *[c + x for c in amounts for x in ("", REST, KNOWN)])
    else:
        bucketed = df.select(
            confidence_bucket_id("forecast_confidence_score").alias("bucket_id"),
            F.col("record_id").cast("string").alias("record_id"), *[F.col(c).cast("double").alias(c) for c in amounts])
    placeholders = spark.range(len(CONFIDENCE_LABELS), numPartitions=1).select(F.col("id").cast("int").alias("bucket_id"), *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in bucketed.schema.fields if f.name != "bucket_id"])
    bucketed = bucketed.unionByName(placeholders)
    forecast, actual, confidence = amounts
    zero = F.lit(0.0)
    return (
        bucketed.groupBy("bucket_id")
        .agg(
            F.coalesce(records(bucketed), F.lit(0)).alias("records"),
            F.coalesce(total(bucketed, forecast), zero).alias("forecast_revenue"),
            F.coalesce(total(bucketed, actual), zero).alias("actual_revenue"),
            mean(bucketed, confidence).alias("avg_confidence"),
        )
        .withColumn("accuracy_ratio", F.when(
            F.col("forecast_revenue") > 0,
            round_half_even(F.col("actual_revenue") / F.col("forecast_revenue"), 3)).otherwise(zero))
        .orderBy(F.asc_nulls_last("bucket_id"))
        .select(
            confidence_bucket_label("bucket_id").alias("confidence_bucket"),
            "records", "forecast_revenue", "actual_revenue", "avg_confidence", "accuracy_ratio",
        )
    )
