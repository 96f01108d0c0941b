"""Rollups, buckets, trends, risk scores (FIXTURES 2, SURVEY 2.14 rules 3, 6-8, 13)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import col_values, typed_facts
from quotaflow.operators import (
    aggregate_by,
    apply_filters,
    filter_options,
    forecast_confidence,
    high_revenue_accounts,
    is_empty_slice,
    kpi_status,
    pipeline_share,
    quality_report,
    quota_heatmap,
    revenue_growth_trend,
    revenue_risk_customers,
    safe_minmax,
    top_metrics,
    underperforming_teams,
)


def test_confidence_buckets(spark):
    scores = [0, 0.5, 0.500001, 0.7, 0.85, 1.0, 1.0001]
    df = typed_facts(spark, [{"record_id": f"R{i}", "forecast_confidence_score": s} for i, s in enumerate(scores)])
    out = {r["confidence_bucket"]: r["records"] for r in forecast_confidence(df).collect()}
    assert out == {"Low (<0.5)": 2, "Moderate (0.5-0.7)": 2, "High (0.7-0.85)": 1, "Very High (0.85+)": 2}


def test_out_of_range_scores_form_a_null_bucket_sorted_last(spark):
    df = typed_facts(spark, [{"forecast_confidence_score": -0.1}, {"forecast_confidence_score": 1.1}])
    rows = forecast_confidence(df).collect()
    assert len(rows) == 5
    assert rows[-1]["confidence_bucket"] is None and rows[-1]["records"] == 2


def test_empty_buckets_are_kept(spark):
    df = typed_facts(spark, [{"forecast_confidence_score": 0.2, "forecasted_revenue_next_quarter": 10,
                              "monthly_recurring_revenue_eur": 5},
                             {"forecast_confidence_score": 0.3, "forecasted_revenue_next_quarter": 10}])
    rows = forecast_confidence(df).collect()
    assert [r["confidence_bucket"] for r in rows] == [
        "Low (<0.5)", "Moderate (0.5-0.7)", "High (0.7-0.85)", "Very High (0.85+)"]
    assert rows[0]["records"] == 2 and rows[0]["accuracy_ratio"] == 0.25
    for r in rows[1:]:
        assert (r["records"], r["forecast_revenue"], r["actual_revenue"], r["avg_confidence"],
                r["accuracy_ratio"]) == (0, 0.0, 0.0, None, 0.0)


def test_growth_over_rows_not_calendar(spark):
    df = typed_facts(spark, [
        {"reporting_month": "2025-01", "monthly_recurring_revenue_eur": 0},
        {"reporting_month": "2025-02", "monthly_recurring_revenue_eur": 5},
        {"reporting_month": "2025-04", "monthly_recurring_revenue_eur": -5},
    ])
    rows = revenue_growth_trend(df).collect()
    assert [r["mom_growth_pct"] for r in rows] == [None, None, -200.0]
    assert [r["rolling_3m_revenue"] for r in rows] == [0.0, 2.5, 0.0]


def test_growth_partitioned_by_key(spark):
    df = typed_facts(spark, [
        {"region": "A", "reporting_month": "2025-01", "monthly_recurring_revenue_eur": 10},
        {"region": "A", "reporting_month": "2025-02", "monthly_recurring_revenue_eur": 20},
        {"region": "B", "reporting_month": "2025-02", "monthly_recurring_revenue_eur": 7},
    ])
    rows = revenue_growth_trend(df, by=["region"]).collect()
    assert [(r["region"], r["mom_growth_pct"]) for r in rows] == [("A", None), ("A", 100.0), ("B", None)]


def test_constant_minmax_is_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "x double")
    assert col_values(safe_minmax(df, "x"), "x_norm") == [0.0, 0.0, 0.0]
    one = spark.createDataFrame([(5.0,)], "x double")
    assert col_values(safe_minmax(one, "x"), "x_norm") == [0.0]


def test_minmax_in_unit_interval(spark):
    df = spark.range(100).select((F.col("id") * 7 % 13).cast("double").alias("x"))
    vals = col_values(safe_minmax(df, "x"), "x_norm")
    assert min(vals) == 0.0 and max(vals) == 1.0


def test_ties_broken_by_keys(spark):
    rows = [{"customer_name": n, "industry": "I", "region": "R", "churned_revenue_eur": 0,
             "renewal_probability_pct": 50, "customer_growth_score": 50,
             "monthly_recurring_revenue_eur": 10} for n in ["c", "a", "b"]]
    out = revenue_risk_customers(typed_facts(spark, rows), top_n=2).collect()
    assert [r["customer_name"] for r in out] == ["a", "b"]
    assert out[0]["risk_score"] == out[1]["risk_score"]


def test_risk_score_formula(spark):
    rows = [
        {"customer_name": "big", "monthly_recurring_revenue_eur": 100, "churned_revenue_eur": 10,
         "renewal_probability_pct": 40, "customer_growth_score": 120},
        {"customer_name": "small", "monthly_recurring_revenue_eur": 0, "churned_revenue_eur": 0,
         "renewal_probability_pct": 100, "customer_growth_score": 0},
    ]
    out = {r["customer_name"]: r["risk_score"] for r in revenue_risk_customers(typed_facts(spark, rows)).collect()}
    # big: (0.5*1 + 0.3*0.6 + 0.2*0) * (0.4 + 0.6*1) = 0.68; small: (0 + 0 + 0.2) * 0.4 = 0.08
    assert out == {"big": 0.68, "small": 0.08}


def test_empty_input(spark):
    df = typed_facts(spark, [{}]).limit(0)
    m = top_metrics(df).first().asDict()
    assert all(v == 0.0 for v in m.values())
    assert aggregate_by(df, "region").count() == 0
    assert forecast_confidence(df).count() == 4
    assert kpi_status(top_metrics(df)).first()["quota_status"] == "danger"
    assert quality_report(df).first()["max_revenue_diff_eur"] is None


def test_unknown_dimension(spark):
    with pytest.raises(KeyError, match="nope"):
        aggregate_by(typed_facts(spark, [{}]), "nope")


def test_filters(spark):
    rows = [{"record_id": str(i), "region": r, "subscription_plan": p}
            for i, (r, p) in enumerate([("EMEA", "A"), ("EMEA", "B"), ("APAC", "A"), ("LATAM", "B")])]
    df = typed_facts(spark, rows)
    assert apply_filters(df, regions=[]).count() == 4
    assert apply_filters(df, regions=None).count() == 4
    assert apply_filters(df, regions=["EMEA", "APAC"]).count() == 3
    assert apply_filters(df, regions=["EMEA", "APAC"], plans=["A"]).count() == 2
    assert apply_filters(df, regions=["emea"]).count() == 0
    assert is_empty_slice(apply_filters(df, regions=["nowhere"]))
    # filters commute and slices add up to the whole
    a = apply_filters(apply_filters(df, plans=["A"]), regions=["EMEA"]).count()
    b = apply_filters(apply_filters(df, regions=["EMEA"]), plans=["A"]).count()
    assert a == b == 1
    parts = sum(apply_filters(df, regions=[r]).count() for r in ["EMEA", "APAC", "LATAM"])
    assert parts == df.count()


def test_null_record_id_not_counted_but_summed(spark):
    df = typed_facts(spark, [{"record_id": None, "monthly_recurring_revenue_eur": 3},
                             {"record_id": "x", "monthly_recurring_revenue_eur": 4}])
    row = aggregate_by(df, "region").first()
    assert row["records"] == 1 and row["total_revenue_eur"] == 7.0


def test_filter_options_long_table(spark):
    df = typed_facts(spark, [{"region": "B"}, {"region": "A"}, {"region": "A", "product_line": "X"}])
    out = [(r["dimension"], r["value"]) for r in filter_options(df).collect()]
    assert ("regions", "A") in out and ("regions", "B") in out
    assert out == sorted(out)
    assert len([o for o in out if o[0] == "regions"]) == 2


def test_underperforming_threshold_is_strict(spark):
    df = typed_facts(spark, [{"sales_team": "T1", "quota_attainment_pct": 50, "account_executive": "a"},
                             {"sales_team": "T2", "quota_attainment_pct": 40, "account_executive": "a"},
                             {"sales_team": "T2", "quota_attainment_pct": 40, "account_executive": "b"}])
    rows = underperforming_teams(df, 50.0).collect()
    assert [(r["sales_team"], r["reps"], r["gap_to_quota_pct"]) for r in rows] == [("T2", 2, 60.0)]


def test_heatmap_and_share(spark):
    df = typed_facts(spark, [
        {"region": "A", "sales_team": "t1", "quota_attainment_pct": 10.25, "sales_stage": "X",
         "pipeline_value_eur": 30},
        {"region": "B", "sales_team": "t2", "quota_attainment_pct": 20, "sales_stage": "Y",
         "pipeline_value_eur": 10},
    ])
    hm = quota_heatmap(df).collect()
    assert [tuple(r) for r in hm] == [("A", 10.2, 0.0), ("B", 0.0, 20.0)]
    share = {r["sales_stage"]: r["share_pct"] for r in pipeline_share(df).collect()}
    assert share == {"X": 75.0, "Y": 25.0}


def test_top_accounts_limit_and_order(spark):
    rows = [{"customer_name": f"c{i}", "monthly_recurring_revenue_eur": i} for i in range(20)]
    out = high_revenue_accounts(typed_facts(spark, rows), top_n=3).collect()
    assert [r["customer_name"] for r in out] == ["c19", "c18", "c17"]


def test_missing_path_raises(spark):
    from pyspark.errors import AnalysisException

    from quotaflow.sources import load_revenue

    with pytest.raises(AnalysisException):
        load_revenue(spark, "/nonexistent/folder/revenue.csv")


def test_quality_report_approx_counts(spark):
    rows = [{"record_id": str(i), "region": f"R{i % 3}", "product_line": f"P{i % 2}"} for i in range(12)]
    q = quality_report(typed_facts(spark, rows), approx=True).first()
    assert (q["rows"], q["regions"], q["products"], q["teams"]) == (12, 3, 2, 1)
