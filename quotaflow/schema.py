"""Column contract of the revenue fact table.

Fixed values: the names, their order and the feature lists below must equal
the source contract exactly, because error messages list missing columns in
this order and the model features are built in this order.
"""

from __future__ import annotations

# --- fixed values: required source columns, in declared order -------------
REQUIRED_COLUMNS: tuple[str, ...] = (
    "record_id",
    "region",
    "country",
    "sales_team",
    "account_executive",
    "customer_name",
    "industry",
    "reporting_month",
    "subscription_plan",
    "monthly_recurring_revenue_eur",
    "expansion_revenue_eur",
    "renewal_revenue_eur",
    "churned_revenue_eur",
    "pipeline_value_eur",
    "closed_won_value_eur",
    "closed_lost_value_eur",
    "sales_target_eur",
    "quota_attainment_pct",
    "forecasted_revenue_next_quarter",
    "forecast_confidence_score",
    "customer_growth_score",
    "renewal_probability_pct",
    "product_line",
    "sales_stage",
)

# --- fixed values: text columns that are stripped, missing -> "nan" -------
TEXT_COLUMNS: tuple[str, ...] = (
    "region",
    "country",
    "sales_team",
    "account_executive",
    "customer_name",
    "industry",
    "subscription_plan",
    "product_line",
    "sales_stage",
)

# --- fixed values: numeric columns, junk or missing -> 0.0 ----------------
NUMERIC_COLUMNS: tuple[str, ...] = (
    "monthly_recurring_revenue_eur",
    "expansion_revenue_eur",
    "renewal_revenue_eur",
    "churned_revenue_eur",
    "pipeline_value_eur",
    "closed_won_value_eur",
    "closed_lost_value_eur",
    "sales_target_eur",
    "quota_attainment_pct",
    "forecasted_revenue_next_quarter",
    "forecast_confidence_score",
    "customer_growth_score",
    "renewal_probability_pct",
)

# Columns added by ``enrich``.
DERIVED_COLUMNS: tuple[str, ...] = (
    "total_revenue_eur",
    "net_new_revenue_eur",
    "pipeline_conversion_pct",
    "year",
    "quarter",
    "month_label",
    "is_revenue_risk",
)

# Columns added by ``RevenueForecaster.predict_next_quarter``.
PREDICTION_COLUMNS: tuple[str, ...] = (
    "predicted_revenue_next_quarter",
    "predicted_meets_quota",
    "quota_attainment_probability",
)

# --- fixed values: model features, in order -------------------------------
CATEGORICAL_FEATURES: tuple[str, ...] = (
    "region",
    "country",
    "sales_team",
    "subscription_plan",
    "product_line",
    "sales_stage",
    "industry",
)

NUMERIC_FEATURES: tuple[str, ...] = (
    "monthly_recurring_revenue_eur",
    "expansion_revenue_eur",
    "renewal_revenue_eur",
    "pipeline_value_eur",
    "closed_won_value_eur",
    "sales_target_eur",
    "quota_attainment_pct",
    "customer_growth_score",
    "renewal_probability_pct",
    "forecast_confidence_score",
    "year",
    "month_num",
)

REGRESSION_TARGET = "forecasted_revenue_next_quarter"
QUOTA_LABEL_SOURCE = "quota_attainment_pct"
QUOTA_MET_AT = 100.0

# Filter dimensions: argument name -> column.
FILTER_DIMENSIONS: dict[str, str] = {
    "regions": "region",
    "products": "product_line",
    "teams": "sales_team",
    "plans": "subscription_plan",
}


def missing_columns(columns) -> list[str]:
    """Required columns absent from ``columns``, in declared order."""
    present = set(columns)
    return [c for c in REQUIRED_COLUMNS if c not in present]
