"""Column expressions shared by the operators."""

from quotaflow.functions.columns import (
    CONFIDENCE_EDGES,
    CONFIDENCE_LABELS,
    clip,
    confidence_bucket_id,
    confidence_bucket_label,
    guarded_ratio,
    kpi_band,
    month_from_text,
    number_from_text,
    round_half_even,
    strip_text,
    zero_filled,
)

__all__ = [
    "CONFIDENCE_EDGES",
    "CONFIDENCE_LABELS",
    "clip",
    "confidence_bucket_id",
    "confidence_bucket_label",
    "guarded_ratio",
    "kpi_band",
    "month_from_text",
    "number_from_text",
    "round_half_even",
    "strip_text",
    "zero_filled",
]
