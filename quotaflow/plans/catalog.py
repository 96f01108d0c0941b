"""Registered queries over the star tables and their SQL oracles.

Each query maps the star tables to revenue facts, runs one or more operators
and rounds in the outermost projection only (sums to cents, means and
ratios to 8 places, scores as the operator gives them), so two engines that
sum in a different order still agree exactly. The SQL strings run in DuckDB
over the same Parquet tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.functions import round_half_even
from quotaflow.operators import (
    aggregate_by,
    apply_filters,
    churn_impact,
    clean,
    filter_options,
    forecast_confidence,
    forecast_vs_actual,
    high_revenue_accounts,
    is_empty_slice,
    kpi_status,
    ml_risk_accounts,
    pipeline_distribution,
    pipeline_share,
    prepare,
    quality_report,
    quota_heatmap,
    quota_matrix,
    quota_trend,
    quota_trend_series,
    revenue_by_product,
    revenue_by_region,
    revenue_growth_trend,
    revenue_risk_customers,
    top_metrics,
    underperforming_teams,
)
from quotaflow.session import ensure_checkpoint_dir
from quotaflow.sources import (
    dataset_fingerprint,
    dirty_star_facts,
    load_revenue,
    star_facts,
    with_standin_predictions,
)
from quotaflow.schema import FILTER_DIMENSIONS
from quotaflow.sources.star import clear_table_cache
from quotaflow.sources import store as stores
from quotaflow.sources.store import Folder, Store, drop_store, open_store, sources_state

# Parameters of the registered queries.
SLICE_REGIONS = ["ASIA", "EUROPE"]
SLICE_PLANS = ["1-URGENT", "2-HIGH"]
NO_SUCH_REGION = "__no_such_region__"
TEAM_THRESHOLD_PCT = 101.5
TOP_N = 15
STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ROLLUP_DIMENSIONS = ["region", "product_line", "sales_team", "subscription_plan"]


# (application id, sf_dir, kind) -> DataFrame, shared by every query of a
# session, as an application holding its facts DataFrame would.
_PLANS: dict[tuple[str, str, str], DataFrame] = {}
# (application id, sf_dir, kind) -> times of change of the table paths, store
_STORES: dict[tuple[str, str, str], tuple[tuple, Store]] = {}


def _plan(spark: SparkSession, sf_dir: str, kind: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def reset_plans() -> None:
    """Forget the shared plans and opened stores; the tables stay on disk."""
    _PLANS.clear()
    _STORES.clear()
    clear_table_cache()


def facts_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and enriched facts planned from the star tables (the 7-table
    join runs again with every action)."""
    return _plan(spark, sf_dir, "facts", lambda: prepare(star_facts(spark, sf_dir)))


def facts_folder(spark: SparkSession) -> str:
    """Where facts stores are kept: below the shared folder the session names in
    ``spark.checkpoint.dir``, whatever application asks, else below the session's own one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/quotaflow-facts"


def _sources(sf_dir: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in STAR_TABLES]


def fact_slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The facts of ``facts_plan`` in as many slices of the order keys as the bytes of the source tables ask for."""
    n = -(-Folder(spark, sf_dir).bytes(_sources(sf_dir)) // stores.SLICE_BYTES)
    return [prepare(star_facts(spark, sf_dir, (i, n) if n > 1 else None)) for i in range(max(n, 1))]


def store_root(spark: SparkSession, sf_dir: str) -> str:
    return f"{facts_folder(spark)}/{hashlib.sha1(sf_dir.rstrip('/').encode()).hexdigest()[:16]}"


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The facts store of the star tables (S6): opened if this state of the tables has one, whoever
    wrote it, else written once.

    The source files are listed when an application first asks, and again only when the time of change of
    a table's own path has changed; changes further down a partitioned table are seen by the next application
    or after ``reset_plans``. A session without a shared folder, or a failed write, is an error.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "store")
    changed = Folder(spark, sf_dir).changed_at(_sources(sf_dir))
    if key not in _STORES or _STORES[key][0] != changed:
        clear_table_cache()  # the files may have been replaced since they were listed
        state = sources_state(spark, _sources(sf_dir))
        _STORES[key] = changed, open_store(spark, store_root(spark, sf_dir), state, lambda: fact_slices(spark, sf_dir),
                                           with_standin_predictions, ["quota_attainment_probability"])
    return _STORES[key][1]


def drop_facts_tables(spark: SparkSession) -> bool:
    """Delete the stores that this application has opened and forget them (the next ``facts`` call writes
    a new one). Returns whether anything was deleted."""
    app = spark.sparkContext.applicationId
    opened = [_STORES.pop(k)[1] for k in list(_STORES) if k[0] == app]
    for key in [k for k in _PLANS if k[0] == app and k[2].startswith("standin-")]:
        _PLANS.pop(key)
    return any([drop_store(spark, s.root, s.manifest["state"]) for s in opened])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and enriched facts mapped from the whole star tables: the store's clustered table."""
    return store(spark, sf_dir).facts


def states_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The facts added up by at least these dimensions: the store's smallest such table."""
    return store(spark, sf_dir).states(*columns)


def dirty_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirtied star facts (FIXTURES 5), not yet cleaned."""
    return _plan(spark, sf_dir, "dirty", lambda: dirty_star_facts(spark, sf_dir))


def rounded(df: DataFrame, money=(), ratio=()) -> DataFrame:
    """Outer rounding for cross-engine comparison: ``money`` columns to 2
    places, ``ratio`` columns to 8, half-even; column order kept."""
    spec = {c: 2 for c in money} | {c: 8 for c in ratio}
    return df.select([
        round_half_even(F.col(c), spec[c]).alias(c) if c in spec else F.col(c) for c in df.columns
    ])


# ---------------------------------------------------------------- Spark side

_A3_MONEY = ("total_revenue_eur", "mrr_eur", "expansion_eur", "renewal_eur", "churn_eur",
             "pipeline_eur", "closed_won_eur", "forecast_eur")
_A3_RATIO = ("avg_quota_pct", "avg_confidence")
_A1_MONEY = ("total_revenue", "forecasted_revenue", "churned_revenue", "pipeline_value")
_A1_RATIO = ("avg_quota_attainment", "avg_confidence")


def _aggregate_by(column: str):
    def run(spark, d):
        return rounded(aggregate_by(states_of(spark, d, column), column), _A3_MONEY, _A3_RATIO)
    return run


def _predictions(spark, d):
    base = facts(spark, d)
    return _plan(spark, d, f"standin-{''.join(base.inputFiles()[:1])}", lambda: with_standin_predictions(base))


def _empty_slice_flags(spark, d):
    """F3 on a slice without rows and on one with rows."""
    none = is_empty_slice(apply_filters(facts(spark, d), regions=[NO_SUCH_REGION]))
    some = is_empty_slice(apply_filters(facts(spark, d), regions=SLICE_REGIONS, plans=SLICE_PLANS))
    return spark.range(1).select(F.lit(none).alias("no_such_region"), F.lit(some).alias("slice"))


def _build_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    q["clean_dirty"] = lambda s, d: clean(dirty_facts(s, d))
    q["enrich_facts"] = lambda s, d: facts(s, d)
    q["filter_slice"] = lambda s, d: apply_filters(facts(s, d), regions=SLICE_REGIONS, plans=SLICE_PLANS)
    q["filter_options"] = lambda s, d: filter_options(states_of(s, d, *FILTER_DIMENSIONS.values()))
    q["dataset_fingerprint"] = lambda s, d: rounded(dataset_fingerprint(facts(s, d)), ["total_revenue"])
    q["top_metrics"] = lambda s, d: rounded(top_metrics(states_of(s, d)), _A1_MONEY, _A1_RATIO)
    q["top_metrics_empty"] = lambda s, d: rounded(
        top_metrics(apply_filters(states_of(s, d, "region"), regions=[NO_SUCH_REGION])), _A1_MONEY, _A1_RATIO)
    q["kpi_status"] = lambda s, d: rounded(kpi_status(top_metrics(states_of(s, d))), _A1_MONEY, _A1_RATIO)
    q["quality_report"] = lambda s, d: rounded(quality_report(states_of(s, d, *FILTER_DIMENSIONS.values())), ratio=["max_revenue_diff_eur"])
    q["aggregate_by_plan"] = _aggregate_by("subscription_plan")
    q["aggregate_by_region"] = _aggregate_by("region")
    q["aggregate_by_product"] = _aggregate_by("product_line")
    q["aggregate_by_team"] = _aggregate_by("sales_team")
    q["revenue_by_region"] = lambda s, d: rounded(
        revenue_by_region(states_of(s, d, "region")), ["total_revenue", "forecast_revenue", "churn", "pipeline"])
    q["revenue_by_product"] = lambda s, d: rounded(revenue_by_product(states_of(s, d, "month_label", "product_line")), ["total_revenue"])
    q["forecast_vs_actual"] = lambda s, d: rounded(
        forecast_vs_actual(states_of(s, d, "month_label")), ["actual_revenue", "forecast_revenue", "variance"], ["variance_pct"])
    q["pipeline_distribution"] = lambda s, d: rounded(
        pipeline_distribution(states_of(s, d, "sales_stage")), ["pipeline_value", "closed_won", "closed_lost"])
    q["pipeline_share"] = lambda s, d: rounded(pipeline_share(states_of(s, d, "sales_stage")), ["pipeline_value"], ["share_pct"])
    q["quota_matrix"] = lambda s, d: rounded(quota_matrix(states_of(s, d, "region", "sales_team")), ratio=["avg_quota"])
    q["quota_heatmap"] = lambda s, d: quota_heatmap(states_of(s, d, "region", "sales_team"))
    q["high_revenue_accounts"] = lambda s, d: rounded(
        high_revenue_accounts(facts(s, d), TOP_N), ["total_revenue", "mrr", "expansion", "renewal"],
        ["avg_renewal_prob"])
    q["revenue_risk_customers"] = lambda s, d: rounded(
        revenue_risk_customers(facts(s, d), TOP_N), ["mrr", "churn"],
        ["avg_renewal_prob", "avg_growth_score", "avg_quota"])
    q["underperforming_teams"] = lambda s, d: rounded(
        underperforming_teams(facts(s, d), TEAM_THRESHOLD_PCT), ["total_revenue", "forecast_revenue"],
        ["avg_quota", "avg_confidence"])
    q["revenue_growth_trend"] = lambda s, d: rounded(revenue_growth_trend(states_of(s, d, "month_label")), ["total_revenue"])
    q["revenue_growth_by_region"] = lambda s, d: rounded(
        revenue_growth_trend(states_of(s, d, "month_label", "region"), by=["region"]), ["total_revenue"])
    q["churn_impact"] = lambda s, d: rounded(
        churn_impact(states_of(s, d, "region")), ["gross_revenue", "expansion", "renewal", "churn", "gross_total", "net_revenue"])
    q["forecast_confidence"] = lambda s, d: rounded(
        forecast_confidence(states_of(s, d, "bucket_id")), ["forecast_revenue", "actual_revenue"], ["avg_confidence"])
    q["forecast_confidence_gaps"] = lambda s, d: rounded(
        forecast_confidence(facts(s, d).filter(F.col("quota_attainment_pct") < 100)),
        ["forecast_revenue", "actual_revenue"], ["avg_confidence"])
    q["quota_trend"] = lambda s, d: rounded(
        quota_trend(states_of(s, d, "month_label")), ratio=["actual_quota_avg", "predicted_quota_prob"])
    q["quota_trend_series"] = lambda s, d: rounded(
        quota_trend_series(quota_trend(states_of(s, d, "month_label"))),
        ratio=["actual_quota_avg", "predicted_quota_prob", "actual_revenue", "forecast_revenue"])
    q["ml_risk_accounts"] = lambda s, d: rounded(
        ml_risk_accounts(_predictions(s, d), TOP_N), ["mrr", "forecast", "predicted", "churn"],
        ["miss_quota_prob"])
    q["quota_trend_slice"] = lambda s, d: rounded(
        quota_trend(apply_filters(_predictions(s, d), regions=SLICE_REGIONS, plans=SLICE_PLANS)),
        ratio=["actual_quota_avg", "predicted_quota_prob"])
    q["load_revenue_star"] = lambda s, d: load_revenue(s, star_facts(s, d))
    q["empty_slice_flags"] = _empty_slice_flags
    from quotaflow.plans.bundle import rollup_by_dimensions
    q["aggregate_by_dimensions"] = lambda s, d: rounded(
        rollup_by_dimensions(states_of(s, d, *ROLLUP_DIMENSIONS), ROLLUP_DIMENSIONS), _A3_MONEY, _A3_RATIO)
    return q


QUERIES = _build_queries()


# ------------------------------------------------------------------ SQL side

def r2(x: str) -> str:
    return f"round_even(({x}) * 100E0, 0) / 100E0"


def r3(x: str) -> str:
    return f"round_even(({x}) * 1000E0, 0) / 1000E0"


def r8(x: str) -> str:
    return f"round_even(({x}) * 100000000E0, 0) / 100000000E0"


def _raw_sql(dirty: bool = False) -> str:
    q = "CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR)"
    month = "substr(CAST(o.o_orderdate AS VARCHAR), 1, 7)"
    if dirty:
        region = ("CASE WHEN l.l_linenumber = 1 THEN '  ' || r.r_name || chr(9) "
                  "WHEN l.l_linenumber = 2 THEN NULL ELSE r.r_name END")
        mrr = (f"CASE WHEN l.l_linenumber = 3 THEN 'n/a' WHEN l.l_linenumber = 4 THEN ' ' || {q} || ' ' "
               f"WHEN l.l_linenumber = 5 THEN '1,000' WHEN l.l_linenumber = 6 THEN {q} || 'f' "
               f"WHEN l.l_linenumber = 7 THEN '' ELSE {q} END")
        month = (f"CASE WHEN l.l_linenumber = 5 THEN '2025-13' WHEN l.l_linenumber = 6 THEN NULL "
                 f"ELSE {month} END")
    else:
        region = "r.r_name"
        mrr = r2("l.l_extendedprice * (1.0E0 - l.l_discount)")
    return f"""
    SELECT
      'REC-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS record_id,
      {region} AS region,
      n.n_name AS country,
      r.r_name || '-T' || CAST(s.s_suppkey % 3 AS VARCHAR) AS sales_team,
      s.s_name AS account_executive,
      c.c_name AS customer_name,
      c.c_mktsegment AS industry,
      {month} AS reporting_month,
      o.o_orderpriority AS subscription_plan,
      {mrr} AS monthly_recurring_revenue_eur,
      {r2("l.l_extendedprice * l.l_tax")} AS expansion_revenue_eur,
      CASE WHEN l.l_returnflag = 'A' THEN l.l_extendedprice ELSE 0.0E0 END AS renewal_revenue_eur,
      CASE WHEN l.l_returnflag = 'R' THEN {r2("l.l_extendedprice * 1.5E0")} ELSE 0.0E0 END
        AS churned_revenue_eur,
      o.o_totalprice AS pipeline_value_eur,
      CASE WHEN o.o_orderstatus = 'F' AND l.l_linestatus = 'F' THEN l.l_extendedprice ELSE 0.0E0 END
        AS closed_won_value_eur,
      CASE WHEN o.o_orderstatus = 'F' AND l.l_linestatus = 'O' THEN l.l_extendedprice ELSE 0.0E0 END
        AS closed_lost_value_eur,
      {r2("p.p_retailprice * 50.0E0")} AS sales_target_eur,
      l.l_quantity * 4.0E0 AS quota_attainment_pct,
      {r2("o.o_totalprice * 0.25E0")} AS forecasted_revenue_next_quarter,
      l.l_quantity / 50.0E0 AS forecast_confidence_score,
      CAST(p.p_size * 2 AS DOUBLE) AS customer_growth_score,
      CAST(l.l_partkey % 101 AS DOUBLE) AS renewal_probability_pct,
      p.p_type AS product_line,
      CASE WHEN o.o_orderstatus = 'F' AND l.l_linestatus = 'F' THEN 'Closed Won'
           WHEN o.o_orderstatus = 'F' AND l.l_linestatus = 'O' THEN 'Closed Lost'
           WHEN o.o_orderstatus = 'O' THEN 'Negotiation'
           ELSE 'Proposal' END AS sales_stage
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    """


_ENRICH_SQL = f"""
    SELECT *,
      {r2("monthly_recurring_revenue_eur + expansion_revenue_eur + renewal_revenue_eur - churned_revenue_eur")}
        AS total_revenue_eur,
      {r2("monthly_recurring_revenue_eur + expansion_revenue_eur - churned_revenue_eur")} AS net_new_revenue_eur,
      {r2("CASE WHEN pipeline_value_eur > 0 THEN closed_won_value_eur / pipeline_value_eur * 100.0E0 "
          "ELSE 0.0E0 END")} AS pipeline_conversion_pct,
      CAST(year(reporting_month) AS INTEGER) AS year,
      CAST(year(reporting_month) AS VARCHAR) || 'Q' || CAST(quarter(reporting_month) AS VARCHAR) AS quarter,
      strftime(reporting_month, '%Y-%m') AS month_label,
      (churned_revenue_eur > 0
        OR (renewal_probability_pct < 60 AND monthly_recurring_revenue_eur > 0)
        OR (quota_attainment_pct < 25 AND sales_target_eur > 0)) AS is_revenue_risk
    FROM cleaned
"""

# raw -> cleaned (month parsed, rows without a month dropped) -> enriched
FACTS_CTE = f"""
WITH raw AS ({_raw_sql()}),
cleaned AS (
    SELECT * REPLACE (CAST(try_strptime(reporting_month, '%Y-%m') AS DATE) AS reporting_month)
    FROM raw WHERE try_strptime(reporting_month, '%Y-%m') IS NOT NULL
),
enriched AS ({_ENRICH_SQL})
"""

_PRED_CTE = f""",
pred AS (
    SELECT *,
      {r2("forecasted_revenue_next_quarter * (0.5E0 + forecast_confidence_score)")}
        AS predicted_revenue_next_quarter,
      CASE WHEN quota_attainment_pct / 200.0E0 >= 0.5E0 THEN 1 ELSE 0 END AS predicted_meets_quota,
      quota_attainment_pct / 200.0E0 AS quota_attainment_probability
    FROM enriched
)
"""

_NUMBER_RE = r"\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*"


def _clean_dirty_sql() -> str:
    text_cols = ["country", "sales_team", "account_executive", "customer_name", "industry",
                 "subscription_plan", "product_line", "sales_stage"]
    num_cols = ["expansion_revenue_eur", "renewal_revenue_eur", "churned_revenue_eur",
                "pipeline_value_eur", "closed_won_value_eur", "closed_lost_value_eur", "sales_target_eur",
                "quota_attainment_pct", "forecasted_revenue_next_quarter", "forecast_confidence_score",
                "customer_growth_score", "renewal_probability_pct"]
    sel = {
        "record_id": "record_id",
        "region": r"coalesce(regexp_replace(region, '^\s+|\s+$', '', 'g'), 'nan')",
        "reporting_month": "CAST(try_strptime(reporting_month, '%Y-%m') AS DATE)",
        "monthly_recurring_revenue_eur": (
            f"coalesce(CASE WHEN regexp_full_match(monthly_recurring_revenue_eur, '{_NUMBER_RE}') "
            f"THEN TRY_CAST(trim(monthly_recurring_revenue_eur) AS DOUBLE) END, 0.0E0)"),
    }
    sel.update({c: f"coalesce({c}, 'nan')" for c in text_cols})
    sel.update({c: f"coalesce({c}, 0.0E0)" for c in num_cols})
    from quotaflow.schema import REQUIRED_COLUMNS
    cols = ",\n      ".join(f"{sel[c]} AS {c}" for c in REQUIRED_COLUMNS)
    return f"""
WITH raw AS ({_raw_sql(dirty=True)})
SELECT {cols}
FROM raw WHERE try_strptime(reporting_month, '%Y-%m') IS NOT NULL
"""


def _slots_sql(most: int = 256) -> str:
    """Rows by slot of the model's features: a value's if it is among the column's most frequent
    ones or there are few, the others' together, and those other than 0 of a number."""
    from quotaflow.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES

    numbers = {"month_num": "month(reporting_month)", "year": "year(reporting_month)"}
    values = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v, count(*) AS n FROM enriched GROUP BY {c}" for c in CATEGORICAL_FEATURES)
    counts = " UNION ALL ".join(f"SELECT 'num__{c}', count(*) FILTER (WHERE {numbers.get(c, c)} <> 0) FROM enriched" for c in NUMERIC_FEATURES)
    return f"""v AS ({values}),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS place, count(*) OVER (PARTITION BY c) AS held FROM v WHERE v IS NOT NULL)
SELECT 'cat__' || c || '_' || CASE WHEN held <= {most} OR place <= {most} THEN v ELSE '__other__' END AS feature, CAST(sum(n) AS BIGINT) AS rows
FROM p GROUP BY ALL UNION ALL {counts}"""


def _a3_sql(column: str) -> str:
    return FACTS_CTE + f"""
SELECT {column},
  {r2("sum(total_revenue_eur)")} AS total_revenue_eur,
  {r2("sum(monthly_recurring_revenue_eur)")} AS mrr_eur,
  {r2("sum(expansion_revenue_eur)")} AS expansion_eur,
  {r2("sum(renewal_revenue_eur)")} AS renewal_eur,
  {r2("sum(churned_revenue_eur)")} AS churn_eur,
  {r2("sum(pipeline_value_eur)")} AS pipeline_eur,
  {r2("sum(closed_won_value_eur)")} AS closed_won_eur,
  {r2("sum(forecasted_revenue_next_quarter)")} AS forecast_eur,
  {r8("avg(quota_attainment_pct)")} AS avg_quota_pct,
  {r8("avg(forecast_confidence_score)")} AS avg_confidence,
  count(record_id) AS records
FROM enriched GROUP BY {column} ORDER BY sum(total_revenue_eur) DESC, {column}
"""


def _a1_sql(where: str = "") -> str:
    return FACTS_CTE + f"""
SELECT
  {r2("coalesce(sum(total_revenue_eur), 0.0E0)")} AS total_revenue,
  {r2("coalesce(sum(forecasted_revenue_next_quarter), 0.0E0)")} AS forecasted_revenue,
  {r8("coalesce(avg(quota_attainment_pct), 0.0E0)")} AS avg_quota_attainment,
  {r2("coalesce(sum(churned_revenue_eur), 0.0E0)")} AS churned_revenue,
  {r2("coalesce(sum(pipeline_value_eur), 0.0E0)")} AS pipeline_value,
  {r8("coalesce(avg(forecast_confidence_score), 0.0E0)")} AS avg_confidence
FROM enriched {where}
"""


def _bucket_sql(where: str = "") -> str:
    return FACTS_CTE + f""",
b AS (
  SELECT CASE
      WHEN forecast_confidence_score >= 0.0E0 AND forecast_confidence_score <= 0.5E0 THEN 0
      WHEN forecast_confidence_score > 0.5E0 AND forecast_confidence_score <= 0.7E0 THEN 1
      WHEN forecast_confidence_score > 0.7E0 AND forecast_confidence_score <= 0.85E0 THEN 2
      WHEN forecast_confidence_score > 0.85E0 AND forecast_confidence_score <= 1.0001E0 THEN 3
    END AS bucket_id, record_id, forecasted_revenue_next_quarter AS forecast,
    total_revenue_eur AS actual, forecast_confidence_score AS confidence
  FROM enriched {where}
),
dim AS (
  SELECT * FROM (VALUES (0, 'Low (<0.5)'), (1, 'Moderate (0.5-0.7)'), (2, 'High (0.7-0.85)'),
                        (3, 'Very High (0.85+)')) v(bucket_id, label)
),
agg AS (
  SELECT bucket_id, count(record_id) AS records, coalesce(sum(forecast), 0.0E0) AS forecast_revenue,
         coalesce(sum(actual), 0.0E0) AS actual_revenue, avg(confidence) AS avg_confidence
  FROM b GROUP BY bucket_id
),
full_agg AS (
  SELECT dim.bucket_id, dim.label, coalesce(agg.records, 0) AS records,
         coalesce(agg.forecast_revenue, 0.0E0) AS forecast_revenue,
         coalesce(agg.actual_revenue, 0.0E0) AS actual_revenue, agg.avg_confidence
  FROM dim LEFT JOIN agg ON dim.bucket_id = agg.bucket_id
  UNION ALL
  SELECT NULL, NULL, records, forecast_revenue, actual_revenue, avg_confidence FROM agg WHERE bucket_id IS NULL
)
SELECT label AS confidence_bucket, CAST(records AS BIGINT) AS records,
  {r2("forecast_revenue")} AS forecast_revenue, {r2("actual_revenue")} AS actual_revenue,
  {r8("avg_confidence")} AS avg_confidence,
  CASE WHEN forecast_revenue > 0 THEN {r3("actual_revenue / forecast_revenue")} ELSE 0.0E0 END AS accuracy_ratio
FROM full_agg ORDER BY bucket_id NULLS LAST
"""


def _build_oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    o["clean_dirty"] = _clean_dirty_sql()
    o["enrich_facts"] = FACTS_CTE + "SELECT * FROM enriched"
    regions = ", ".join(f"'{x}'" for x in SLICE_REGIONS)
    plans = ", ".join(f"'{x}'" for x in SLICE_PLANS)
    o["filter_slice"] = FACTS_CTE + (
        f"SELECT * FROM enriched WHERE region IN ({regions}) AND subscription_plan IN ({plans})")
    o["filter_options"] = FACTS_CTE + """
SELECT DISTINCT * FROM (
  SELECT 'regions' AS dimension, region AS value FROM enriched
  UNION ALL SELECT 'products', product_line FROM enriched
  UNION ALL SELECT 'teams', sales_team FROM enriched
  UNION ALL SELECT 'plans', subscription_plan FROM enriched
) WHERE value IS NOT NULL ORDER BY dimension, value
"""
    o["dataset_fingerprint"] = FACTS_CTE + f"""
SELECT count(*) AS rows, {r2("coalesce(sum(total_revenue_eur), 0.0E0)")} AS total_revenue,
  printf('%d-%.2f', count(*), coalesce(sum(total_revenue_eur), 0.0E0)) AS fingerprint
FROM enriched
"""
    o["top_metrics"] = _a1_sql()
    o["top_metrics_empty"] = _a1_sql(f"WHERE region IN ('{NO_SUCH_REGION}')")
    o["kpi_status"] = FACTS_CTE + f"""
, k AS (
  SELECT coalesce(sum(total_revenue_eur), 0.0E0) AS t, coalesce(sum(forecasted_revenue_next_quarter), 0.0E0) AS f,
    coalesce(avg(quota_attainment_pct), 0.0E0) AS q, coalesce(sum(churned_revenue_eur), 0.0E0) AS c,
    coalesce(sum(pipeline_value_eur), 0.0E0) AS p, coalesce(avg(forecast_confidence_score), 0.0E0) AS conf
  FROM enriched
)
SELECT {r2("t")} AS total_revenue, {r2("f")} AS forecasted_revenue, {r8("q")} AS avg_quota_attainment,
  {r2("c")} AS churned_revenue, {r2("p")} AS pipeline_value, {r8("conf")} AS avg_confidence,
  CASE WHEN q >= 80 THEN 'good' WHEN q >= 50 THEN 'warn' ELSE 'danger' END AS quota_status
FROM k
"""
    o["quality_report"] = FACTS_CTE + f"""
SELECT count(*) AS rows, count(DISTINCT region) AS regions, count(DISTINCT product_line) AS products,
  count(DISTINCT sales_team) AS teams,
  {r8("max(abs(total_revenue_eur - (monthly_recurring_revenue_eur + expansion_revenue_eur + renewal_revenue_eur - churned_revenue_eur)))")} AS max_revenue_diff_eur,
  count(*) FILTER (WHERE total_revenue_eur < 0) AS negative_revenue_rows,
  count(*) FILTER (WHERE sales_target_eur <= 0) AS missing_targets
FROM enriched
"""
    o["aggregate_by_plan"] = _a3_sql("subscription_plan")
    o["aggregate_by_region"] = _a3_sql("region")
    o["aggregate_by_product"] = _a3_sql("product_line")
    o["aggregate_by_team"] = _a3_sql("sales_team")
    o["revenue_by_region"] = FACTS_CTE + f"""
SELECT region, {r2("sum(total_revenue_eur)")} AS total_revenue,
  {r2("sum(forecasted_revenue_next_quarter)")} AS forecast_revenue,
  {r2("sum(churned_revenue_eur)")} AS churn, {r2("sum(pipeline_value_eur)")} AS pipeline
FROM enriched GROUP BY region ORDER BY sum(total_revenue_eur) DESC, region
"""
    o["revenue_by_product"] = FACTS_CTE + f"""
SELECT month_label, product_line, {r2("sum(total_revenue_eur)")} AS total_revenue
FROM enriched GROUP BY month_label, product_line ORDER BY month_label, product_line
"""
    o["forecast_vs_actual"] = FACTS_CTE + f"""
SELECT month_label, {r2("a")} AS actual_revenue, {r2("f")} AS forecast_revenue, {r2("a - f")} AS variance,
  {r8("CASE WHEN f > 0 THEN (a - f) / f * 100.0E0 ELSE 0.0E0 END")} AS variance_pct
FROM (SELECT month_label, sum(total_revenue_eur) AS a, sum(forecasted_revenue_next_quarter) AS f
      FROM enriched GROUP BY month_label) ORDER BY month_label
"""
    o["pipeline_distribution"] = FACTS_CTE + f"""
SELECT sales_stage, {r2("sum(pipeline_value_eur)")} AS pipeline_value, count(record_id) AS opportunities,
  {r2("sum(closed_won_value_eur)")} AS closed_won, {r2("sum(closed_lost_value_eur)")} AS closed_lost
FROM enriched GROUP BY sales_stage ORDER BY sum(pipeline_value_eur) DESC, sales_stage
"""
    o["pipeline_share"] = FACTS_CTE + f"""
, st AS (SELECT sales_stage, sum(pipeline_value_eur) AS pv FROM enriched GROUP BY sales_stage)
SELECT sales_stage, {r2("pv")} AS pipeline_value,
  {r8("pv / nullif((SELECT sum(pv) FROM st), 0) * 100.0E0")} AS share_pct
FROM st ORDER BY share_pct DESC, sales_stage
"""
    o["quota_matrix"] = FACTS_CTE + f"""
SELECT region, sales_team, {r8("avg(quota_attainment_pct)")} AS avg_quota
FROM enriched GROUP BY region, sales_team ORDER BY region, sales_team
"""
    # The query finds its teams in the facts; SQL must name them: the fact mapping makes three a region.
    teams = [f"{r}-T{i}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST") for i in range(3)]
    cells = ",\n  ".join(
        f"round_even(coalesce(avg(quota_attainment_pct) FILTER (WHERE sales_team = '{t}'), 0.0E0) * 10E0, 0) / 10E0 AS \"{t}\""
        for t in teams)
    o["quota_heatmap"] = FACTS_CTE + f"""
SELECT region, {cells}
FROM enriched GROUP BY region ORDER BY region
"""
    o["high_revenue_accounts"] = FACTS_CTE + f"""
SELECT customer_name, industry, region, {r2("sum(total_revenue_eur)")} AS total_revenue,
  {r2("sum(monthly_recurring_revenue_eur)")} AS mrr, {r2("sum(expansion_revenue_eur)")} AS expansion,
  {r2("sum(renewal_revenue_eur)")} AS renewal, {r8("avg(renewal_probability_pct)")} AS avg_renewal_prob
FROM enriched GROUP BY customer_name, industry, region
ORDER BY sum(total_revenue_eur) DESC, customer_name, industry, region LIMIT {TOP_N}
"""
    churn_n = "CASE WHEN chi - clo > 0 THEN (churn - clo) / (chi - clo) ELSE 0.0E0 END"
    mrr_n = "CASE WHEN mhi - mlo > 0 THEN (mrr - mlo) / (mhi - mlo) ELSE 0.0E0 END"
    renewal_risk = "(100.0E0 - least(greatest(avg_renewal_prob, 0.0E0), 100.0E0)) / 100.0E0"
    growth_risk = "(100.0E0 - least(greatest(avg_growth_score, 0.0E0), 100.0E0)) / 100.0E0"
    o["revenue_risk_customers"] = FACTS_CTE + f"""
, acc AS (
  SELECT customer_name, industry, region, sum(monthly_recurring_revenue_eur) AS mrr,
    sum(churned_revenue_eur) AS churn, avg(renewal_probability_pct) AS avg_renewal_prob,
    avg(customer_growth_score) AS avg_growth_score, avg(quota_attainment_pct) AS avg_quota,
    count(record_id) AS records
  FROM enriched GROUP BY customer_name, industry, region
), st AS (SELECT min(churn) AS clo, max(churn) AS chi, min(mrr) AS mlo, max(mrr) AS mhi FROM acc),
sc AS (
  SELECT acc.*, {r3(f"(0.5E0 * {churn_n} + 0.3E0 * {renewal_risk} + 0.2E0 * {growth_risk}) * (0.4E0 + 0.6E0 * {mrr_n})")} AS risk_score
  FROM acc CROSS JOIN st
)
SELECT customer_name, industry, region, {r2("mrr")} AS mrr, {r2("churn")} AS churn,
  {r8("avg_renewal_prob")} AS avg_renewal_prob, {r8("avg_growth_score")} AS avg_growth_score,
  {r8("avg_quota")} AS avg_quota, records, risk_score
FROM sc ORDER BY risk_score DESC, customer_name, industry, region LIMIT {TOP_N}
"""
    o["underperforming_teams"] = FACTS_CTE + f"""
, g AS (
  SELECT sales_team, region, avg(quota_attainment_pct) AS avg_quota, sum(total_revenue_eur) AS total_revenue,
    sum(forecasted_revenue_next_quarter) AS forecast_revenue, avg(forecast_confidence_score) AS avg_confidence,
    count(DISTINCT account_executive) AS reps, count(record_id) AS records
  FROM enriched GROUP BY sales_team, region
)
SELECT sales_team, region, {r8("avg_quota")} AS avg_quota, {r2("total_revenue")} AS total_revenue,
  {r2("forecast_revenue")} AS forecast_revenue, {r8("avg_confidence")} AS avg_confidence, reps, records,
  {r2("100.0E0 - avg_quota")} AS gap_to_quota_pct
FROM g WHERE avg_quota < {TEAM_THRESHOLD_PCT}E0 ORDER BY g.avg_quota, sales_team, region
"""
    growth = lambda part: FACTS_CTE + f"""
, m AS (SELECT {part} month_label, CAST(sum(CAST(total_revenue_eur AS DECIMAL(28,2))) AS DOUBLE) AS total
        FROM enriched GROUP BY ALL)
SELECT {part} month_label, {r2("total")} AS total_revenue,
  {r2("(total / nullif(lag(total) OVER w, 0.0E0) - 1.0E0) * 100.0E0")} AS mom_growth_pct,
  {r2("avg(total) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")} AS rolling_3m_revenue
FROM m WINDOW w AS ({"PARTITION BY region " if part else ""}ORDER BY month_label)
ORDER BY {part} month_label
"""  # noqa: E731
    o["revenue_growth_trend"] = growth("")
    o["revenue_growth_by_region"] = growth("region,")
    o["churn_impact"] = FACTS_CTE + f"""
, g AS (
  SELECT region, sum(monthly_recurring_revenue_eur) AS gross_revenue, sum(expansion_revenue_eur) AS expansion,
    sum(renewal_revenue_eur) AS renewal, sum(churned_revenue_eur) AS churn
  FROM enriched GROUP BY region
), t AS (SELECT *, gross_revenue + expansion + renewal AS gross_total FROM g)
SELECT region, {r2("gross_revenue")} AS gross_revenue, {r2("expansion")} AS expansion,
  {r2("renewal")} AS renewal, {r2("churn")} AS churn, {r2("gross_total")} AS gross_total,
  {r2("gross_total - churn")} AS net_revenue,
  {r2("CASE WHEN gross_total > 0 THEN churn / gross_total * 100.0E0 ELSE 0.0E0 END")} AS churn_rate_pct
FROM t ORDER BY t.churn DESC, region
"""
    o["forecast_confidence"] = _bucket_sql()
    o["forecast_confidence_gaps"] = _bucket_sql("WHERE quota_attainment_pct < 100")
    slice_sql = "region IN ({}) AND subscription_plan IN ({})".format(
        *(", ".join(f"'{v}'" for v in values) for values in (SLICE_REGIONS, SLICE_PLANS)))
    o["quota_trend_slice"] = FACTS_CTE + _PRED_CTE + f"""
SELECT month_label, {r8("avg(quota_attainment_pct)")} AS actual_quota_avg,
  {r8("avg(quota_attainment_probability)")} AS predicted_quota_prob, count(record_id) AS records
FROM pred WHERE {slice_sql} GROUP BY month_label ORDER BY month_label
"""
    o["load_revenue_star"] = o["enrich_facts"]
    o["empty_slice_flags"] = FACTS_CTE + f"""
SELECT count(*) FILTER (WHERE region = '{NO_SUCH_REGION}') = 0 AS no_such_region,
  count(*) FILTER (WHERE {slice_sql}) = 0 AS slice FROM enriched
"""
    o["split_sizes"] = FACTS_CTE + """
, f AS (SELECT CASE WHEN quota_attainment_pct >= 100 THEN 1 ELSE 0 END AS label,
          CAST(CAST('0x' || substr(md5(record_id || '|42'), 1, 8) AS BIGINT) % 10000 AS INTEGER) AS slot FROM enriched),
c AS (SELECT label, slot, count(*) AS n FROM f GROUP BY label, slot),
u AS (SELECT label, slot, sum(n) OVER (PARTITION BY label ORDER BY slot) AS upto, sum(n) OVER (PARTITION BY label) AS total FROM c),
cut AS (SELECT label, min(slot) AS last FROM u WHERE upto >= total * 0.8E0 GROUP BY label)
SELECT 'plain' AS split, label, slot < 8000 AS train, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT 'stratified', f.label, slot <= last, count(*) FROM f JOIN cut ON cut.label = f.label GROUP BY ALL
"""
    o["feature_slots"] = FACTS_CTE + ", " + _slots_sql()
    o["baseline_scores"] = FACTS_CTE + """
, f AS (SELECT CASE WHEN quota_attainment_pct >= 100 THEN 1 ELSE 0 END AS label, forecasted_revenue_next_quarter AS y, total_revenue_eur AS p,
          CAST(CAST('0x' || substr(md5(record_id || '|42'), 1, 8) AS BIGINT) % 10000 AS INTEGER) AS slot FROM enriched),
c AS (SELECT label, slot, count(*) AS n FROM f GROUP BY label, slot),
u AS (SELECT label, slot, n, sum(n) OVER (PARTITION BY label ORDER BY slot) AS upto, sum(n) OVER (PARTITION BY label) AS total FROM c),
cut AS (SELECT label, min(slot) AS last FROM u WHERE upto >= total * 0.8E0 GROUP BY label),
side AS (SELECT u.label, sum(n) FILTER (WHERE slot <= last) AS train, coalesce(sum(n) FILTER (WHERE slot > last), 0) AS test
         FROM u JOIN cut ON cut.label = u.label GROUP BY u.label),
best AS (SELECT test FROM side ORDER BY train DESC, label LIMIT 1)
SELECT count(*) AS held_out, round_even(avg(abs(y - p)), 4) AS mae_eur,
  round_even(1.0E0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
  round_even((SELECT test FROM best) / (SELECT CAST(sum(test) AS DOUBLE) FROM side), 8) AS majority_accuracy
FROM f WHERE slot >= 8000
"""
    o["model_reuse"] = FACTS_CTE + f"""
, f AS (SELECT count(*) AS rows, CAST(count(*) AS VARCHAR) || '-' || CAST(CAST(sum(CAST(total_revenue_eur AS DECIMAL(24,2))) AS DECIMAL(38,2)) AS VARCHAR) AS fingerprint,
          count(*) FILTER (WHERE sales_stage = 'Proposal') AS proposals FROM enriched)
SELECT CAST(step AS INTEGER) AS step, rows, fingerprint, rows AS predictions,
  CASE WHEN step = 2 THEN proposals ELSE CAST(0 AS BIGINT) END AS edited, step IN (0, 2) AS refitted
FROM f, (SELECT unnest([0, 1, 2, 3]) AS step)
"""
    o["predict_checks"] = FACTS_CTE + """
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS disagreeing FROM enriched
"""
    o["importance_checks"] = "SELECT true AS at_most_20, CAST(0 AS BIGINT) AS unknown_names, CAST(0 AS BIGINT) AS outside"
    o["quota_trend"] = FACTS_CTE + _PRED_CTE + f"""
SELECT month_label, {r8("avg(quota_attainment_pct)")} AS actual_quota_avg,
  {r8("avg(quota_attainment_probability)")} AS predicted_quota_prob, count(record_id) AS records
FROM pred GROUP BY month_label ORDER BY month_label
"""
    o["quota_trend_series"] = FACTS_CTE + _PRED_CTE + f"""
, t AS (SELECT month_label, avg(quota_attainment_pct) AS q, avg(quota_attainment_probability) AS p,
          count(record_id) AS records FROM pred GROUP BY month_label)
SELECT month_label, {r8("q")} AS actual_quota_avg, {r8("p")} AS predicted_quota_prob, records,
  {r8("q")} AS actual_revenue, {r8("p * 100.0E0")} AS forecast_revenue
FROM t ORDER BY month_label
"""
    gap_n = ("CASE WHEN ghi - glo > 0 THEN (greatest(forecast_gap_eur, 0.0E0) - glo) / (ghi - glo) "
             "ELSE 0.0E0 END")
    churn_n2 = "CASE WHEN chi - clo > 0 THEN (churn - clo) / (chi - clo) ELSE 0.0E0 END"
    o["ml_risk_accounts"] = FACTS_CTE + _PRED_CTE + f"""
, acc AS (
  SELECT customer_name, region, industry, sum(monthly_recurring_revenue_eur) AS mrr,
    sum(forecasted_revenue_next_quarter) AS forecast, sum(predicted_revenue_next_quarter) AS predicted,
    1.0E0 - avg(quota_attainment_probability) AS miss_quota_prob, sum(churned_revenue_eur) AS churn
  FROM pred GROUP BY customer_name, region, industry
), acc2 AS (SELECT *, {r2("forecast - predicted")} AS forecast_gap_eur FROM acc),
st AS (SELECT min(greatest(forecast_gap_eur, 0.0E0)) AS glo, max(greatest(forecast_gap_eur, 0.0E0)) AS ghi,
              min(churn) AS clo, max(churn) AS chi FROM acc2),
sc AS (SELECT acc2.*, {r3(f"0.5E0 * {gap_n} + 0.3E0 * miss_quota_prob + 0.2E0 * {churn_n2}")} AS ml_risk_score
       FROM acc2 CROSS JOIN st)
SELECT customer_name, region, industry, {r2("mrr")} AS mrr, {r2("forecast")} AS forecast,
  {r2("predicted")} AS predicted, {r8("miss_quota_prob")} AS miss_quota_prob, {r2("churn")} AS churn,
  forecast_gap_eur, ml_risk_score
FROM sc ORDER BY ml_risk_score DESC, customer_name, region, industry LIMIT {TOP_N}
"""
    def _dim_sql(column: str) -> str:
        return f"""
SELECT '{column}' AS dimension, CAST({column} AS VARCHAR) AS value,
  {r2("sum(total_revenue_eur)")} AS total_revenue_eur,
  {r2("sum(monthly_recurring_revenue_eur)")} AS mrr_eur,
  {r2("sum(expansion_revenue_eur)")} AS expansion_eur,
  {r2("sum(renewal_revenue_eur)")} AS renewal_eur,
  {r2("sum(churned_revenue_eur)")} AS churn_eur,
  {r2("sum(pipeline_value_eur)")} AS pipeline_eur,
  {r2("sum(closed_won_value_eur)")} AS closed_won_eur,
  {r2("sum(forecasted_revenue_next_quarter)")} AS forecast_eur,
  {r8("avg(quota_attainment_pct)")} AS avg_quota_pct,
  {r8("avg(forecast_confidence_score)")} AS avg_confidence,
  count(record_id) AS records
FROM enriched GROUP BY {column}"""
    o["aggregate_by_dimensions"] = FACTS_CTE + "\nUNION ALL\n".join(_dim_sql(c) for c in ROLLUP_DIMENSIONS)

    from quotaflow.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
    feats = [c for c in CATEGORICAL_FEATURES] + [c for c in NUMERIC_FEATURES if c != "month_num"]
    o["prepare_features"] = FACTS_CTE + (
        f"SELECT {', '.join(feats)}, CAST(month(reporting_month) AS INTEGER) AS month_num FROM enriched")
    return o


ORACLE_SQL = _build_oracle()
