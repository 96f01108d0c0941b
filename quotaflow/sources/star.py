"""Revenue facts mapped from the TPC-H style star tables.

Grain: one fact per ``lineitem`` row (inner equi-joins lineitem -> orders ->
customer -> nation -> region, lineitem -> part, lineitem -> supplier).

Join plan, chosen for scale: ``orders`` is joined to ``customer`` first, so the
shuffle on the customer key moves order-sized rows rather than
lineitem-sized ones; ``lineitem`` meets ``part`` and ``supplier`` while its rows are
narrow, and the wide order rows last. The fact-to-fact join (lineitem with orders) is hinted
as a sort-merge join: neither side is ever broadcast, whatever the
(compressed-file) size estimate says, both are hash-partitioned on the order
key, and adaptive execution splits a skewed key's partition. The dimension
joins are left to Spark's size check: a side is broadcast only when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (file
statistics at planning, actual shuffle sizes under adaptive execution), else
it is a sort-merge join too. ``nation`` and ``region`` always fall under the
threshold. Each table is pruned to the columns it
feeds, and the text filters of a slice are pushed below the joins to the
dimension scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.functions import round_half_even
from quotaflow.schema import REQUIRED_COLUMNS

# (application id, path) -> DataFrame: a table's schema is read once per
# session, as a catalog table would be, instead of once per query.
_TABLES: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def clear_table_cache() -> None:
    """Forget the table DataFrames (call after files are replaced)."""
    _TABLES.clear()


def _slice_of(df: DataFrame, key: str, part: tuple[int, int] | None) -> DataFrame:
    """The rows whose key falls into one of several slices; None: all rows."""
    return df if part is None else df.where(F.pmod(F.xxhash64(key), F.lit(part[1])) == part[0])


def star_join(spark: SparkSession, sf_dir: str, part_of: tuple[int, int] | None = None) -> DataFrame:
    """The joined source columns that the fact mapping reads. ``part_of`` (i, n) takes the i-th of n slices of the
    order keys: together they are the whole join, each row once."""
    t = lambda name: read_table(spark, sf_dir, name)
    region = t("region").select("r_regionkey", "r_name")
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name")
    customer = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    customer = customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                "o_orderdate", "o_orderpriority")
    orders = _slice_of(orders, "o_orderkey", part_of).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lineitem = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                    "l_returnflag", "l_linestatus")
    part = t("part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    supplier = t("supplier").select("s_suppkey", "s_name")
    return (
        _slice_of(lineitem, "l_orderkey", part_of)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    )


def _r2(c: Column) -> Column:
    return round_half_even(c, 2)


def _fact_columns() -> dict[str, Column]:
    """Fact column -> expression over the joined star columns."""
    price = F.col("l_extendedprice")
    order_f = F.col("o_orderstatus") == "F"
    zero = F.lit(0.0)
    return {
        "record_id": F.concat(F.lit("REC-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                              F.col("l_linenumber").cast("string")),
        "region": F.col("r_name"),
        "country": F.col("n_name"),
        "sales_team": F.concat(F.col("r_name"), F.lit("-T"), (F.col("s_suppkey") % 3).cast("string")),
        "account_executive": F.col("s_name"),
        "customer_name": F.col("c_name"),
        "industry": F.col("c_mktsegment"),
        # the first 7 characters of the order date as text, i.e. YYYY-MM
        "reporting_month": F.date_format(F.col("o_orderdate"), "yyyy-MM"),
        "subscription_plan": F.col("o_orderpriority"),
        "monthly_recurring_revenue_eur": _r2(price * (F.lit(1.0) - F.col("l_discount"))),
        "expansion_revenue_eur": _r2(price * F.col("l_tax")),
        "renewal_revenue_eur": F.when(F.col("l_returnflag") == "A", price).otherwise(zero),
        "churned_revenue_eur": F.when(F.col("l_returnflag") == "R", _r2(price * F.lit(1.5))).otherwise(zero),
        "pipeline_value_eur": F.col("o_totalprice"),
        "closed_won_value_eur": F.when(order_f & (F.col("l_linestatus") == "F"), price).otherwise(zero),
        "closed_lost_value_eur": F.when(order_f & (F.col("l_linestatus") == "O"), price).otherwise(zero),
        "sales_target_eur": _r2(F.col("p_retailprice") * F.lit(50.0)),
        "quota_attainment_pct": F.col("l_quantity") * F.lit(4.0),
        "forecasted_revenue_next_quarter": _r2(F.col("o_totalprice") * F.lit(0.25)),
        "forecast_confidence_score": F.col("l_quantity") / F.lit(50.0),
        "customer_growth_score": (F.col("p_size") * 2).cast("double"),
        "renewal_probability_pct": (F.col("l_partkey") % 101).cast("double"),
        "product_line": F.col("p_type"),
        "sales_stage": (
            F.when(order_f & (F.col("l_linestatus") == "F"), F.lit("Closed Won"))
            .when(order_f & (F.col("l_linestatus") == "O"), F.lit("Closed Lost"))
            .when(F.col("o_orderstatus") == "O", F.lit("Negotiation"))
            .otherwise(F.lit("Proposal"))
        ),
    }


def star_facts(spark: SparkSession, sf_dir: str, part_of: tuple[int, int] | None = None) -> DataFrame:
    """Raw revenue records (the 24 source columns, month as ``YYYY-MM`` text)
    mapped from the star tables, or from a slice of the orders (``star_join``); feed to ``prepare`` / ``load_revenue``."""
    cols = _fact_columns()
    return star_join(spark, sf_dir, part_of).select([cols[c].alias(c) for c in REQUIRED_COLUMNS])


def dirty_star_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star facts with ``region``, ``monthly_recurring_revenue_eur`` and
    ``reporting_month`` replaced by dirty text chosen by ``l_linenumber``:

    ====  =====================  ===============  ============
    line  region                 mrr text         month text
    ====  =====================  ===============  ============
    1     two blanks, name, tab  quantity         as mapped
    2     NULL                   quantity         as mapped
    3     name                   ``n/a``          as mapped
    4     name                   blank-q-blank    as mapped
    5     name                   ``1,000``        ``2025-13``
    6     name                   quantity + ``f`` NULL
    7     name                   empty            as mapped
    ====  =====================  ===============  ============
    """
    cols = _fact_columns()
    line = F.col("l_linenumber")
    qty = F.col("l_quantity").cast("bigint").cast("string")
    cols["region"] = (
        F.when(line == 1, F.concat(F.lit("  "), F.col("r_name"), F.lit("\t")))
        .when(line == 2, F.lit(None).cast("string"))
        .otherwise(F.col("r_name"))
    )
    cols["monthly_recurring_revenue_eur"] = (
        F.when(line == 3, F.lit("n/a"))
        .when(line == 4, F.concat(F.lit(" "), qty, F.lit(" ")))
        .when(line == 5, F.lit("1,000"))
        .when(line == 6, F.concat(qty, F.lit("f")))
        .when(line == 7, F.lit(""))
        .otherwise(qty)
    )
    cols["reporting_month"] = (
        F.when(line == 5, F.lit("2025-13"))
        .when(line == 6, F.lit(None).cast("string"))
        .otherwise(cols["reporting_month"])
    )
    return star_join(spark, sf_dir).select([cols[c].alias(c) for c in REQUIRED_COLUMNS])


def with_standin_predictions(facts: DataFrame) -> DataFrame:
    """A deterministic stand-in for the model outputs, so that the
    prediction rollups can be checked exactly:

    predicted revenue = cents(forecast x (0.5 + confidence)), probability =
    quota / 200, meets quota = 1 when probability >= 0.5.
    """
    prob = F.col("quota_attainment_pct") / F.lit(200.0)
    return facts.withColumns({
        "predicted_revenue_next_quarter": _r2(
            F.col("forecasted_revenue_next_quarter") * (F.lit(0.5) + F.col("forecast_confidence_score"))),
        "predicted_meets_quota": F.when(prob >= 0.5, F.lit(1)).otherwise(F.lit(0)),
        "quota_attainment_probability": prob,
    })
