"""Dimension filters and the option lists that feed them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.schema import FILTER_DIMENSIONS


def apply_filters(df: DataFrame, regions: Iterable[str] | None = None,
                  products: Iterable[str] | None = None,
                  teams: Iterable[str] | None = None,
                  plans: Iterable[str] | None = None) -> DataFrame:
    """Keep rows whose dimension value is in every non-empty list.

    ``None`` or ``[]`` means no filter on that dimension; matching is exact and
    case-sensitive. All lists become one conjunctive ``Filter`` that Catalyst
    pushes as far down as it can (an ``In`` on a plain Parquet column becomes
    a pushed scan filter).
    """
    chosen = {"regions": regions, "products": products, "teams": teams, "plans": plans}
    cond = None
    for arg, column in FILTER_DIMENSIONS.items():
        values = chosen[arg]
        if values is None:
            continue
        values = list(values)
        if not values:
            continue
        term = F.col(column).isin(values)
        cond = term if cond is None else cond & term
    return df if cond is None else df.filter(cond)


def is_empty_slice(df: DataFrame) -> bool:
    """``True`` when the slice has no rows (reads at most one row)."""
    return df.isEmpty()


def filter_options(df: DataFrame) -> DataFrame:
    """Sorted distinct non-null values per filter dimension, as a long
    table ``(dimension, value)`` with dimensions ``regions``, ``products``,
    ``teams``, ``plans``.

    One scan: the combinations of the four columns are de-duplicated first
    (partially aggregated before the shuffle), so only those few rows are unpivoted.
    """
    ids = [F.lit(arg) for arg in FILTER_DIMENSIONS]
    stacked = df.select(*FILTER_DIMENSIONS.values()).distinct().select(F.explode(F.array(*[
        F.struct(name.alias("dimension"), F.col(column).cast("string").alias("value"))
        for name, column in zip(ids, FILTER_DIMENSIONS.values())
    ])).alias("kv"))
    return (
        stacked.select("kv.dimension", "kv.value")
        .dropna(subset=["value"])
        .distinct()
        .orderBy("dimension", "value")
    )
