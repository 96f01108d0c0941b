"""Sums and means that do not depend on the order in which rows are added, over facts or
over their states.

Amounts are added as decimals with six places. Values that are not finite, or that have more
than 18 digits before the point, are added as floating-point numbers beside them and, where
there are any, decide the result. States are facts already added up (``summarize``): they
carry ``n_rows`` and ``n_records``, a decimal under each amount's own name and the
rest under ``<name>__rest``; every operator that uses these helpers takes facts or states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals of one amount and of a sum.
AMOUNT, SUM = "decimal(24,6)", "decimal(38,6)"
LARGE = 1e18
ROWS, RECORDS, REST, KNOWN = "n_rows", "n_records", "__rest", "__known"


def are_states(df: DataFrame) -> bool:
    return ROWS in df.columns


def _plain(c: str) -> Column:
    value = F.col(c).cast("double")
    return F.when(F.abs(value) < LARGE, value)  # neither infinite nor NaN


def _parts(df: DataFrame, c: str) -> tuple[Column, Column, Column]:
    """Aggregates: the decimal sum, the rest, the number of known values."""
    if are_states(df):
        return F.sum(c).cast(SUM), F.sum(c + REST), F.sum(c + KNOWN)
    whole = F.col(c).cast(AMOUNT) if df.schema[c].dataType.typeName() == "decimal" else _plain(c).cast(AMOUNT)
    rest = F.lit(None).cast("double") if df.schema[c].dataType.typeName() == "decimal" else F.when(_plain(c).isNull(), F.col(c).cast("double"))
    return F.sum(whole).cast(SUM), F.sum(rest), F.count(c)


def total(df: DataFrame, c: str) -> Column:
    """The sum of an amount, as a double that is the same for every order of the rows."""
    whole, rest, _ = _parts(df, c)
    return F.when(rest.isNotNull(), rest + F.coalesce(whole.cast("double"), F.lit(0.0))).otherwise(whole.cast("double"))


def mean(df: DataFrame, c: str) -> Column:
    return F.try_divide(total(df, c), _parts(df, c)[2].cast("double"))


def records(df: DataFrame) -> Column:
    """The number of rows with a record id."""
    return F.sum(RECORDS) if are_states(df) else F.count("record_id")


def rows(df: DataFrame) -> Column:
    return F.sum(ROWS) if are_states(df) else F.count(F.lit(1))


def states(df: DataFrame, amounts: list[str]) -> list[Column]:
    """The aggregates that turn facts or states into states."""
    out = [rows(df).alias(ROWS), records(df).alias(RECORDS)]
    for c in amounts:
        whole, rest, known = _parts(df, c)
        out += [whole.alias(c), rest.alias(c + REST), known.alias(c + KNOWN)]
    return out
