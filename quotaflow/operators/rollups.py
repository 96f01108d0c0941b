"""Headline metrics and single-key rollups.

Every rollup is one ``groupBy().agg()``: Spark aggregates partially before the
shuffle, so a hot key costs one row per map task, not one row per record. Amounts
are added exactly (``functions.states``), and all but the account views and exact
distinct counts take the facts' states as well as the facts.
Null keys form their own group, as the source application does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.functions import kpi_band, round_half_even
from quotaflow.functions.states import are_states, mean, records, rows, total


def _sum(df: DataFrame, c: str, alias: str):
    return total(df, c).alias(alias)


def _avg(df: DataFrame, c: str, alias: str):
    return mean(df, c).alias(alias)


def top_metrics(df: DataFrame) -> DataFrame:
    """A1: one row of headline KPIs; an empty input gives all 0.0."""
    zero = F.lit(0.0)
    return df.agg(
        F.coalesce(total(df, "total_revenue_eur"), zero).alias("total_revenue"),
        F.coalesce(total(df, "forecasted_revenue_next_quarter"), zero).alias("forecasted_revenue"),
        F.coalesce(mean(df, "quota_attainment_pct"), zero).alias("avg_quota_attainment"),
        F.coalesce(total(df, "churned_revenue_eur"), zero).alias("churned_revenue"),
        F.coalesce(total(df, "pipeline_value_eur"), zero).alias("pipeline_value"),
        F.coalesce(mean(df, "forecast_confidence_score"), zero).alias("avg_confidence"),
    )


def kpi_status(metrics: DataFrame) -> DataFrame:
    """Band of the average quota: ``good`` (>= 80), ``warn`` (>= 50),
    ``danger``."""
    return metrics.withColumn("quota_status", kpi_band("avg_quota_attainment"))


def quality_report(df: DataFrame, approx: bool = False) -> DataFrame:
    """A2: one-row data-quality report in a single aggregation.

    ``max_revenue_diff_eur`` recomputes total revenue and reports the largest
    absolute difference; on no rows it is NULL. With ``approx=True`` the
    distinct counts use HyperLogLog (bounded memory at any scale).
    """
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    # Reduced to one row a combination first: three distinct counts would copy every fact row.
    keys = ("region", "product_line", "sales_team")
    if are_states(df):
        combined = df.groupBy(*keys).agg(rows(df).alias("n"), F.max("revenue_diff_eur").alias("diff"),
                                         F.sum("negative_revenue_rows").alias("negative"), F.sum("missing_targets").alias("untargeted"))
    else:
        expected = (F.col("monthly_recurring_revenue_eur") + F.col("expansion_revenue_eur")
                    + F.col("renewal_revenue_eur") - F.col("churned_revenue_eur"))
        combined = df.groupBy(*keys).agg(
            rows(df).alias("n"),
            F.max(F.abs(F.col("total_revenue_eur") - expected)).alias("diff"),
            F.count_if(F.col("total_revenue_eur") < 0).alias("negative"),
            F.count_if(F.col("sales_target_eur") <= 0).alias("untargeted"),
        )
    added = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return combined.agg(
        added("n").alias("rows"),
        distinct("region").alias("regions"),
        distinct("product_line").alias("products"),
        distinct("sales_team").alias("teams"),
        F.max("diff").alias("max_revenue_diff_eur"),
        added("negative").alias("negative_revenue_rows"),
        added("untargeted").alias("missing_targets"),
    )


def aggregate_by(df: DataFrame, group_col: str) -> DataFrame:
    """A3: the canonical revenue metrics by any one column, total desc."""
    if group_col not in df.columns:
        raise KeyError(f"no such column to group by: {group_col}")
    return (
        df.groupBy(group_col)
        .agg(
            _sum(df, "total_revenue_eur", "total_revenue_eur"),
            _sum(df, "monthly_recurring_revenue_eur", "mrr_eur"),
            _sum(df, "expansion_revenue_eur", "expansion_eur"),
            _sum(df, "renewal_revenue_eur", "renewal_eur"),
            _sum(df, "churned_revenue_eur", "churn_eur"),
            _sum(df, "pipeline_value_eur", "pipeline_eur"),
            _sum(df, "closed_won_value_eur", "closed_won_eur"),
            _sum(df, "forecasted_revenue_next_quarter", "forecast_eur"),
            _avg(df, "quota_attainment_pct", "avg_quota_pct"),
            _avg(df, "forecast_confidence_score", "avg_confidence"),
            records(df).alias("records"),
        )
        .orderBy(F.desc("total_revenue_eur"), group_col)
    )


def revenue_by_region(df: DataFrame) -> DataFrame:
    """A4: revenue, forecast, churn and pipeline by region, total desc."""
    return (
        df.groupBy("region")
        .agg(
            _sum(df, "total_revenue_eur", "total_revenue"),
            _sum(df, "forecasted_revenue_next_quarter", "forecast_revenue"),
            _sum(df, "churned_revenue_eur", "churn"),
            _sum(df, "pipeline_value_eur", "pipeline"),
        )
        .orderBy(F.desc("total_revenue"), "region")
    )


def revenue_by_product(df: DataFrame) -> DataFrame:
    """A5: monthly revenue per product line, month asc."""
    return (
        df.groupBy("month_label", "product_line")
        .agg(_sum(df, "total_revenue_eur", "total_revenue"))
        .orderBy("month_label", "product_line")
    )


def _pipeline_by_stage(df: DataFrame) -> DataFrame:
    return df.groupBy("sales_stage").agg(
        _sum(df, "pipeline_value_eur", "pipeline_value"),
        records(df).alias("opportunities"),
        _sum(df, "closed_won_value_eur", "closed_won"),
        _sum(df, "closed_lost_value_eur", "closed_lost"),
    )


def pipeline_distribution(df: DataFrame) -> DataFrame:
    """Pipeline, opportunities, won and lost by sales stage, pipeline desc."""
    return _pipeline_by_stage(df).orderBy(F.desc("pipeline_value"), "sales_stage")


def pipeline_share(df: DataFrame) -> DataFrame:
    """Each stage's percent of the total pipeline.

    The total is a one-row aggregate of the (already tiny) stage table,
    joined by broadcast: its size is one row by construction.
    """
    stages = _pipeline_by_stage(df).select("sales_stage", "pipeline_value")
    whole = stages.agg(total(stages, "pipeline_value").alias("_total"))
    return (
        stages.crossJoin(F.broadcast(whole))
        .withColumn("share_pct", F.try_divide(F.col("pipeline_value"), F.col("_total")) * F.lit(100.0))
        .drop("_total")
        .orderBy(F.desc("share_pct"), "sales_stage")
    )


def _quota_by_team(df: DataFrame) -> DataFrame:
    return df.groupBy("region", "sales_team").agg(_avg(df, "quota_attainment_pct", "avg_quota"))


def quota_matrix(df: DataFrame) -> DataFrame:
    """Average quota by region and sales team (long form), key order."""
    return _quota_by_team(df).orderBy("region", "sales_team")


def quota_heatmap(df: DataFrame, teams: list[str] | None = None) -> DataFrame:
    """Region x team matrix of average quota, missing cells 0.0,
    half-even rounded to one decimal; one column per team, teams ascending.

    Pass ``teams`` to skip the job that lists the distinct teams.
    """
    long = _quota_by_team(df)
    grouped = long.groupBy("region")
    if teams is None:
        wide = grouped.pivot("sales_team").agg(F.avg("avg_quota"))
    else:
        wide = grouped.pivot("sales_team", sorted(teams)).agg(F.avg("avg_quota"))
    cells = [c for c in wide.columns if c != "region"]
    return wide.select(
        "region",
        *[round_half_even(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), 1).alias(c) for c in cells],
    ).orderBy("region")


def high_revenue_accounts(df: DataFrame, top_n: int = 15) -> DataFrame:
    """Top ``top_n`` accounts by total revenue (ties broken by the keys)."""
    keys = ["customer_name", "industry", "region"]
    return (
        df.groupBy(*keys)
        .agg(
            _sum(df, "total_revenue_eur", "total_revenue"),
            _sum(df, "monthly_recurring_revenue_eur", "mrr"),
            _sum(df, "expansion_revenue_eur", "expansion"),
            _sum(df, "renewal_revenue_eur", "renewal"),
            _avg(df, "renewal_probability_pct", "avg_renewal_prob"),
        )
        .orderBy(F.desc("total_revenue"), *keys)
        .limit(top_n)
    )


def underperforming_teams(df: DataFrame, threshold_pct: float = 50.0, sketches: DataFrame | None = None) -> DataFrame:
    """Teams whose average quota is strictly below ``threshold_pct``,
    with distinct reps, records and the gap to 100 %, avg quota asc.

    With ``sketches`` (region, sales_team, reps_sketch) ``df`` may be states; reps are then
    estimated, with the relative standard error ``sources.store.SKETCH_ERROR``."""
    keys = ["sales_team", "region"]
    reps = F.countDistinct("account_executive")
    if sketches is not None:
        counted = sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("reps_sketch")).alias("estimate"))
        df = df.join(counted.select(*[F.col(k).alias(f"{k}_of") for k in keys], "estimate"),
                     F.col("sales_team").eqNullSafe(F.col("sales_team_of")) & F.col("region").eqNullSafe(F.col("region_of")), "left")
        reps = F.max("estimate")
    grouped = df.groupBy(*keys).agg(
        _avg(df, "quota_attainment_pct", "avg_quota"),
        _sum(df, "total_revenue_eur", "total_revenue"),
        _sum(df, "forecasted_revenue_next_quarter", "forecast_revenue"),
        _avg(df, "forecast_confidence_score", "avg_confidence"),
        reps.alias("reps"),
        records(df).alias("records"),
    )
    return (
        grouped.withColumn("gap_to_quota_pct", round_half_even(F.lit(100.0) - F.col("avg_quota"), 2))
        .filter(F.col("avg_quota") < F.lit(float(threshold_pct)))
        .orderBy("avg_quota", "sales_team", "region")
    )
