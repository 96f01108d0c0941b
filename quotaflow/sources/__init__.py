"""Readers: revenue records from files or DataFrames, and facts mapped from
the star tables."""

from quotaflow.sources.revenue import (
    DEFAULT_NA_VALUES,
    SchemaError,
    content_fingerprint,
    dataset_fingerprint,
    load_revenue,
    malformed_rows,
    materialize_facts,
    persist_facts,
    read_revenue_csv,
    validate_schema,
)
from quotaflow.sources.star import dirty_star_facts, star_facts, star_join, with_standin_predictions

__all__ = [
    "DEFAULT_NA_VALUES", "SchemaError", "content_fingerprint", "dataset_fingerprint", "dirty_star_facts", "load_revenue",
    "malformed_rows", "materialize_facts", "persist_facts", "read_revenue_csv", "star_facts", "star_join",
    "validate_schema", "with_standin_predictions",
]
