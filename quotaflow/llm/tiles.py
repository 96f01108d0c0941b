"""Packing of embedding tables into blocks of vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is usable: not null or empty, no null or non-finite
    component, and a length above zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return embeddings.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def stack(arrays: pd.Series) -> np.ndarray:
    """The vectors of a column as one float64 matrix."""
    return np.stack([np.asarray(a, dtype=np.float64) for a in arrays]) if len(arrays) else np.zeros((0, 0))


def units(m: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square over- or underflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def matrix(blob: bytes, dim: int, dtype) -> np.ndarray:
    return np.frombuffer(blob, dtype=dtype).reshape(-1, dim)
