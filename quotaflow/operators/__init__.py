"""DataFrame operators: each takes and returns a lazy DataFrame."""

from quotaflow.operators.filters import apply_filters, filter_options, is_empty_slice
from quotaflow.operators.health import churn_impact, forecast_confidence
from quotaflow.operators.prep import clean, enrich, prepare, quota_trend_series
from quotaflow.operators.risk import (
    ml_risk_accounts,
    revenue_risk_customers,
    safe_minmax,
    with_minmax,
)
from quotaflow.operators.rollups import (
    aggregate_by,
    high_revenue_accounts,
    kpi_status,
    pipeline_distribution,
    pipeline_share,
    quality_report,
    quota_heatmap,
    quota_matrix,
    revenue_by_product,
    revenue_by_region,
    top_metrics,
    underperforming_teams,
)
from quotaflow.operators.trends import forecast_vs_actual, quota_trend, revenue_growth_trend

__all__ = [
    "aggregate_by", "apply_filters", "churn_impact", "clean", "enrich", "filter_options",
    "forecast_confidence", "forecast_vs_actual", "high_revenue_accounts", "is_empty_slice",
    "kpi_status", "ml_risk_accounts", "pipeline_distribution", "pipeline_share", "prepare",
    "quality_report", "quota_heatmap", "quota_matrix", "quota_trend", "quota_trend_series",
    "revenue_by_product", "revenue_by_region", "revenue_growth_trend", "revenue_risk_customers",
    "safe_minmax", "top_metrics", "underperforming_teams", "with_minmax",
]
