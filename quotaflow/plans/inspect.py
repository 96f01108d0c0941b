"""Read a DataFrame's physical plan: the checks behind the plan tests
(no Python UDF, filters pushed to the scan, shuffles counted)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def has_python_udf(df: DataFrame) -> bool:
    text = plan_text(df, "extended")
    return bool(re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF|FlatMapGroupsInPandas|MapInPandas",
                          text))


def pushed_filters(df: DataFrame) -> list[str]:
    """The ``PushedFilters`` lists of every scan."""
    return re.findall(r"PushedFilters: \[(.*?)\]", plan_text(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*?>)", plan_text(df))


def shuffle_count(df: DataFrame) -> int:
    """Number of shuffle exchanges in the (initial) physical plan."""
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
                          plan_text(df, "simple")))


def single_partition_exchanges(df: DataFrame) -> int:
    return plan_text(df, "simple").count("Exchange SinglePartition")
