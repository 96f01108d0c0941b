"""Many views from one scan.

A dashboard asks for a dozen rollups of the same slice. Run one by one, each
re-reads (and re-joins) the facts. Two ways to share the work:

- ``rollup_by_dimensions``: several single-key rollups as one grouping-sets
  aggregation: one scan, one shuffle, partial aggregation before it. The
  result is a long table ``(dimension, value, metrics...)``.
- ``dashboard_views``: persist the slice once (memory, spilling to disk) and
  derive every view lazily from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.functions.states import mean, records, total
from quotaflow.operators import (
    aggregate_by,
    churn_impact,
    forecast_confidence,
    forecast_vs_actual,
    high_revenue_accounts,
    pipeline_distribution,
    quality_report,
    quota_matrix,
    revenue_by_product,
    revenue_by_region,
    revenue_growth_trend,
    revenue_risk_customers,
    top_metrics,
    underperforming_teams,
)


def _a3_aggregates(df: DataFrame):
    return [
        total(df, "total_revenue_eur").alias("total_revenue_eur"),
        total(df, "monthly_recurring_revenue_eur").alias("mrr_eur"),
        total(df, "expansion_revenue_eur").alias("expansion_eur"),
        total(df, "renewal_revenue_eur").alias("renewal_eur"),
        total(df, "churned_revenue_eur").alias("churn_eur"),
        total(df, "pipeline_value_eur").alias("pipeline_eur"),
        total(df, "closed_won_value_eur").alias("closed_won_eur"),
        total(df, "forecasted_revenue_next_quarter").alias("forecast_eur"),
        mean(df, "quota_attainment_pct").alias("avg_quota_pct"),
        mean(df, "forecast_confidence_score").alias("avg_confidence"),
        records(df).alias("records"),
    ]


def rollup_by_dimensions(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``aggregate_by`` for every column in ``dims`` at once.

    Returns ``dimension, value`` plus the ``aggregate_by`` metrics, one row
    per (dimension, value); ordered by dimension, then total desc. A NULL key
    stays a NULL ``value`` of its own dimension (``grouping_id`` tells the
    sets apart).
    """
    dims = list(dims)
    missing = [d for d in dims if d not in df.columns]
    if missing:
        raise KeyError(f"no such column to group by: {', '.join(missing)}")
    n = len(dims)
    full = (1 << n) - 1
    grouped = df.groupingSets([[d] for d in dims], *dims).agg(
        *_a3_aggregates(df), F.grouping_id(*dims).alias("_gid"))
    # In grouping_id the first column is the highest bit; a set [d_i] leaves
    # only d_i's bit clear.
    masks = {d: full ^ (1 << (n - 1 - i)) for i, d in enumerate(dims)}
    dimension = None
    value = None
    for d, m in masks.items():
        cond = F.col("_gid") == m
        dimension = (F.when if dimension is None else dimension.when)(cond, F.lit(d))
        value = (F.when if value is None else value.when)(cond, F.col(d).cast("string"))
    metrics = [c for c in grouped.columns if c not in dims and c != "_gid"]
    return (
        grouped.select(dimension.alias("dimension"), value.alias("value"), *metrics)
        .orderBy("dimension", F.desc("total_revenue_eur"), "value")
    )


def dashboard_views(facts: DataFrame, top_n: int = 15, team_threshold_pct: float = 50.0,
                    persist: bool = True) -> dict[str, DataFrame]:
    """Every page view of the source dashboard, derived from one (optionally
    persisted) slice. Nothing runs until a view is acted on; the first action
    fills the cache, later ones read it."""
    base = facts.persist(StorageLevel.MEMORY_AND_DISK) if persist else facts
    return {
        "facts": base,
        "top_metrics": top_metrics(base),
        "quality_report": quality_report(base),
        "revenue_by_region": revenue_by_region(base),
        "revenue_by_product": revenue_by_product(base),
        "forecast_vs_actual": forecast_vs_actual(base),
        "pipeline_distribution": pipeline_distribution(base),
        "quota_matrix": quota_matrix(base),
        "high_revenue_accounts": high_revenue_accounts(base, top_n),
        "revenue_risk_customers": revenue_risk_customers(base, top_n),
        "underperforming_teams": underperforming_teams(base, team_threshold_pct),
        "revenue_growth_trend": revenue_growth_trend(base),
        "churn_impact": churn_impact(base),
        "forecast_confidence": forecast_confidence(base),
        "aggregate_by_plan": aggregate_by(base, "subscription_plan"),
    }
