"""Scalar functions used by the models and the binning code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def relu(x: str | Column) -> Column:
    return F.greatest(F.lit(0.0), _col(x))


def elu(x: str | Column) -> Column:
    x = _col(x)
    return F.when(x > 0, x).otherwise(F.expm1(x))


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    return [float(e) for e in np.linspace(low, high, bins + 1)]


def log_edges(low_exponent: float, high_exponent: float, count: int) -> list[float]:
    """``count`` edges evenly spaced in log10, hence ``count - 1`` bins."""
    return [float(e) for e in np.logspace(low_exponent, high_exponent, count)]
