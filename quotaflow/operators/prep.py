"""Cleaning (P1-P5) and enrichment (P6-P12) of revenue records.

Both are single projections (plus one filter), so Catalyst fuses them with
the scan into one whole-stage-codegen span; no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaflow.functions import (
    guarded_ratio,
    month_from_text,
    number_from_text,
    round_half_even,
    strip_text,
    zero_filled,
)
from quotaflow.schema import NUMERIC_COLUMNS, TEXT_COLUMNS

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                  T.DoubleType, T.DecimalType, T.BooleanType)
_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _numeric(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, _NUMERIC_TYPES):
        return zero_filled(F.col(name))
    return zero_filled(number_from_text(F.col(name)))


def _month(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, _TIME_TYPES):
        return F.col(name)
    return month_from_text(F.col(name))


def clean(df: DataFrame, missing_label: str = "nan") -> DataFrame:
    """Normalise types and drop rows without a valid month.

    - 9 text columns: string, Unicode white space stripped, missing ->
      ``missing_label``.
    - 13 numeric columns: text parsed leniently, junk / NULL / NaN -> 0.0
      (typed numeric columns are only null-filled). ``quota_attainment_pct`` is
      not rescaled.
    - ``reporting_month``: ``YYYY-MM`` text -> date of the first of the month;
      a date or timestamp column is kept as it is. Rows without one are dropped.

    Idempotent: ``clean(clean(df)) == clean(df)``. Other columns pass through.
    """
    exprs = {c: strip_text(F.col(c), missing_label) for c in TEXT_COLUMNS}
    exprs.update({c: _numeric(df, c) for c in NUMERIC_COLUMNS})
    exprs["reporting_month"] = _month(df, "reporting_month")
    return df.withColumns(exprs).filter(F.col("reporting_month").isNotNull())


def enrich(df: DataFrame) -> DataFrame:
    """Add the derived revenue columns.

    total = mrr + expansion + renewal - churn; net new = mrr + expansion -
    churn; conversion = won / pipeline * 100 when pipeline > 0; all three
    half-even rounded to cents. Plus year, ``YYYYQn`` quarter, ``YYYY-MM``
    label and the three-arm revenue-risk flag (all comparisons strict).
    """
    mrr = F.col("monthly_recurring_revenue_eur")
    exp = F.col("expansion_revenue_eur")
    ren = F.col("renewal_revenue_eur")
    churn = F.col("churned_revenue_eur")
    month = F.col("reporting_month")
    # inf - inf is no number: NULL, which sums and means leave out
    known = lambda x: F.when(~F.isnan(x), x)
    return df.withColumns({
        "total_revenue_eur": known(round_half_even(mrr + exp + ren - churn, 2)),
        "net_new_revenue_eur": known(round_half_even(mrr + exp - churn, 2)),
        "pipeline_conversion_pct": round_half_even(
            guarded_ratio("closed_won_value_eur", "pipeline_value_eur", scale=100.0), 2),
        "year": F.year(month),
        "quarter": F.concat(F.year(month).cast("string"), F.lit("Q"),
                            F.quarter(month).cast("string")),
        "month_label": F.date_format(month, "yyyy-MM"),
        "is_revenue_risk": (
            (churn > 0)
            | ((F.col("renewal_probability_pct") < 60) & (mrr > 0))
            | ((F.col("quota_attainment_pct") < 25) & (F.col("sales_target_eur") > 0))
        ),
    })


def prepare(df: DataFrame, missing_label: str = "nan") -> DataFrame:
    """``clean`` then ``enrich``: the analysis-ready fact table."""
    return enrich(clean(df, missing_label))


def quota_trend_series(quota_trend: DataFrame) -> DataFrame:
    """The quota trend shaped as an actual-vs-forecast series
    (``actual_revenue`` = average quota, ``forecast_revenue`` = mean
    probability x 100)."""
    return quota_trend.withColumns({
        "actual_revenue": F.col("actual_quota_avg"),
        "forecast_revenue": F.col("predicted_quota_prob") * F.lit(100.0),
    })
