"""Cleaning and enrichment contract."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import col_values, raw_rows, typed_facts
from quotaflow.functions import round_half_even
from quotaflow.operators import clean, enrich, prepare
from quotaflow.schema import DERIVED_COLUMNS, REQUIRED_COLUMNS
from quotaflow.sources import SchemaError, load_revenue, validate_schema


def test_text_is_stripped_to_one_group(spark):
    df = clean(raw_rows(spark, [{"region": v} for v in ["EMEA", " EMEA ", "\tEMEA\n", " EMEA"]]))
    assert set(col_values(df, "region")) == {"EMEA"}


def test_missing_text_becomes_nan_label(spark):
    df = clean(raw_rows(spark, [{"region": None}]))
    assert col_values(df, "region") == ["nan"]
    assert col_values(clean(raw_rows(spark, [{"region": None}]), missing_label="?"), "region") == ["?"]


@pytest.mark.parametrize("text,expected", [
    ("1e3", 1000.0), (" 5 ", 5.0), ("+4", 4.0), (".5", 0.5), ("5.", 5.0), ("inf", math.inf),
    ("-Infinity", -math.inf), ("\t7\n", 7.0), ("1E3", 1000.0), (" 5", 5.0), ("INF", math.inf),
])
def test_numbers_parse_leniently(spark, text, expected):
    df = clean(raw_rows(spark, [{"monthly_recurring_revenue_eur": text}]))
    assert col_values(df, "monthly_recurring_revenue_eur") == [expected]


@pytest.mark.parametrize("text", ["1,000", "0x10", "True", "1d", "1f", "nan", "", None, "1_000", " 5"])
def test_junk_numbers_become_zero(spark, text):
    df = clean(raw_rows(spark, [{"monthly_recurring_revenue_eur": text}]))
    assert col_values(df, "monthly_recurring_revenue_eur") == [0.0]


def test_months_parse_and_bad_months_drop(spark):
    import datetime as dt

    good = clean(raw_rows(spark, [{"reporting_month": "2025-07"}, {"reporting_month": "2025-7"}]))
    assert col_values(good, "reporting_month") == [dt.date(2025, 7, 1)] * 2
    bad = ["2025-13", "2025-07-01", " 2025-07", "202507", "", None, "2025-07 "]
    assert clean(raw_rows(spark, [{"reporting_month": m} for m in bad])).count() == 0


def test_clean_is_idempotent(spark):
    raw = raw_rows(spark, [
        {"region": "  APAC\t", "monthly_recurring_revenue_eur": " 12.5 ", "reporting_month": "2025-7"},
        {"region": None, "monthly_recurring_revenue_eur": "n/a"},
    ])
    once = clean(raw)
    twice = clean(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.schema == twice.schema


def test_quota_fraction_is_not_scaled(spark):
    df = clean(raw_rows(spark, [{"quota_attainment_pct": "0.53"}]))
    assert col_values(df, "quota_attainment_pct") == [0.53]


@pytest.mark.parametrize("digits,values,expected", [
    (2, [1.005, 0.125, 0.375, 2.675], [1.0, 0.12, 0.38, 2.68]),
    (3, [0.0005, 0.0015, 0.0025, 0.0125], [0.0, 0.002, 0.002, 0.012]),
])
def test_half_even_rounding(spark, digits, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert col_values(df.select(round_half_even("x", digits).alias("r")), "r") == expected


def test_derived_columns(spark):
    df = typed_facts(spark, [{
        "monthly_recurring_revenue_eur": 100.004, "expansion_revenue_eur": 10,
        "renewal_revenue_eur": 5, "churned_revenue_eur": 20, "pipeline_value_eur": 0,
        "closed_won_value_eur": 10, "reporting_month": "2025-08",
    }])
    row = df.first()
    assert row["total_revenue_eur"] == 95.0
    assert row["net_new_revenue_eur"] == 90.0
    assert row["pipeline_conversion_pct"] == 0.0
    assert (row["year"], row["quarter"], row["month_label"]) == (2025, "2025Q3", "2025-08")
    assert list(df.columns) == list(REQUIRED_COLUMNS) + list(DERIVED_COLUMNS)


@pytest.mark.parametrize("row,flag", [
    ({"churned_revenue_eur": 0.01, "renewal_probability_pct": 90}, True),
    ({"renewal_probability_pct": 59.9, "monthly_recurring_revenue_eur": 1}, True),
    ({"renewal_probability_pct": 59.9, "monthly_recurring_revenue_eur": 0}, False),
    ({"renewal_probability_pct": 60, "monthly_recurring_revenue_eur": 1}, False),
    ({"quota_attainment_pct": 24.9, "sales_target_eur": 1, "renewal_probability_pct": 90}, True),
    ({"quota_attainment_pct": 25, "sales_target_eur": 1, "renewal_probability_pct": 90}, False),
])
def test_risk_flag(spark, row, flag):
    base = {"quota_attainment_pct": 50, "renewal_probability_pct": 90}
    assert col_values(typed_facts(spark, [{**base, **row}]), "is_revenue_risk") == [flag]


def test_missing_columns_named_in_declared_order(spark):
    df = raw_rows(spark, [{}]).drop("region", "industry")
    with pytest.raises(SchemaError, match="region, industry"):
        validate_schema(df)


def test_extra_columns_pass_through(spark):
    df = raw_rows(spark, [{}]).withColumn("note", F.lit("x"))
    assert "note" in prepare(df).columns


def test_load_revenue_csv_with_na_tokens(spark, tmp_path):
    header = ",".join(REQUIRED_COLUMNS)
    values = {c: "0" for c in REQUIRED_COLUMNS}
    values.update({"record_id": "R-1", "region": "NA", "country": "DE", "sales_team": "T",
                   "account_executive": "E", "customer_name": "C", "industry": "I",
                   "reporting_month": "2025-07", "subscription_plan": "P", "product_line": "L",
                   "sales_stage": "S", "monthly_recurring_revenue_eur": "12.5",
                   "churned_revenue_eur": "N/A"})
    path = tmp_path / "rev.csv"
    path.write_text(header + "\r\n" + ",".join(values[c] for c in REQUIRED_COLUMNS) + "\r\n")
    df = load_revenue(spark, str(path))
    row = df.first()
    assert row["region"] == "nan"
    assert row["churned_revenue_eur"] == 0.0
    assert row["total_revenue_eur"] == 12.5


def test_enrich_never_divides_by_zero_under_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    df = typed_facts(spark, [{"pipeline_value_eur": 0, "closed_won_value_eur": 10}])
    assert col_values(enrich(df), "pipeline_conversion_pct") == [0.0]


def test_unicode_white_space_is_stripped_but_letters_kept(spark):
    values = [" EMEA", "　EMEA ", "\x1cEMEA\x85", "EMEA "]
    df = clean(raw_rows(spark, [{"region": v} for v in values] + [{"region": "Ärhus "},
                                                                  {"region": " 　"}]))
    assert sorted(col_values(df, "region")) == sorted(["EMEA"] * 4 + ["Ärhus", ""])


def test_month_parse_agrees_with_date_parser(spark):
    texts = [f"{y}-{m}" for y in ["0001", "1999", "2025", "9999"]
             for m in ["0", "00", "1", "01", "9", "09", "10", "12", "13", "7 "]]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    from quotaflow.functions.columns import month_from_text

    rows = df.select("s", month_from_text("s").alias("ours"),
                     F.try_to_date("s", "yyyy-M").alias("parser")).collect()
    assert [(r["s"], r["ours"]) for r in rows] == [(r["s"], r["parser"]) for r in rows]
    # year 0 has no calendar date downstream, and a 3-digit month is not a
    # month in the source's format: both rejected
    odd = spark.createDataFrame([("0000-01",), ("2025-012",), ("2025-007",)], "s string")
    assert [r["d"] for r in odd.select(month_from_text("s").alias("d")).collect()] == [None, None, None]
