"""Small aggregates over samples and their catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import GROUP_COLS, UNIT_COLS

MONTHS_PER_SEASON = 12


def time_coverage(
    df: DataFrame, by: Sequence[str] = tuple(UNIT_COLS), ts: str = "time"
) -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def value_range(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(column).alias("low"), F.max(column).alias("high"))


def check_complete(catalog: DataFrame) -> DataFrame:
    """Seasons that lack monthly units, with the number present."""
    months = catalog.groupBy(*GROUP_COLS).agg(F.countDistinct("month").alias("months"))
    return months.where(F.col("months") < MONTHS_PER_SEASON)


def require_complete(catalog: DataFrame) -> None:
    short = check_complete(catalog).limit(5).collect()
    if short:
        raise ValueError(f"seasons without twelve months: {[tuple(r) for r in short]}")
