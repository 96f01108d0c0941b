from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from quotaflow.schema import NUMERIC_COLUMNS, REQUIRED_COLUMNS  # noqa: E402
from quotaflow.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

DEFAULT_TEXT = {
    "record_id": "R-1",
    "region": "EMEA",
    "country": "Germany",
    "sales_team": "EMEA-North",
    "account_executive": "Exec A",
    "customer_name": "Customer A",
    "industry": "Software",
    "reporting_month": "2025-07",
    "subscription_plan": "Enterprise",
    "product_line": "Core",
    "sales_stage": "Proposal",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app_name="quotaflow-tests")
    yield session


def raw_rows(spark, rows: list[dict]):
    """All-text revenue records (as a CSV would give them); unlisted columns
    take valid defaults, numerics default to "0"."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_COLUMNS])
    data = []
    for r in rows:
        full = {**DEFAULT_TEXT, **{c: "0" for c in NUMERIC_COLUMNS}, **r}
        data.append(tuple(full[c] for c in REQUIRED_COLUMNS))
    return spark.createDataFrame(data, schema)


def typed_facts(spark, rows: list[dict]):
    """Cleaned + enriched facts from hand-made rows with numeric values."""
    from quotaflow.operators import prepare

    df = raw_rows(spark, [{k: (None if v is None else str(v)) for k, v in r.items()} for r in rows])
    return prepare(df)


def col_values(df, column):
    return [r[column] for r in df.select(column).collect()]


__all__ = ["F", "SF_SMALL", "col_values", "raw_rows", "typed_facts"]
