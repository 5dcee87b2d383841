"""The data behind a drawing of one or many layered profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layers import ground_first, running_sum, unit_scale


def layer_boundaries(
    df: DataFrame, value: str, keys: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Boxes to draw, ground first: ``level, z_bottom, z_top, value, shade``.

    A profile is a single row, so heights are summed inside it and nothing is
    shuffled.  ``shade`` is the value's place in the profile's own range.
    """
    stacked = df.select(
        *keys, ground_first("dz", "dz").alias("_dz"), ground_first(value, "dz").alias("_value")
    ).withColumn("_top", running_sum("_dz"))
    bottom = F.slice(F.concat(F.array(F.lit(0.0)), F.col("_top")), 1, F.size("_top"))
    boxes = F.arrays_zip(
        bottom.alias("z_bottom"),
        F.col("_top").alias("z_top"),
        F.col("_value").alias("value"),
        unit_scale("_value").alias("shade"),
    )
    opened = stacked.select(*keys, F.posexplode(boxes).alias("level", "_box"))
    return opened.select(*keys, "level", "_box.*")


def layer_scale(
    df: DataFrame, column: str, keys: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Present values of one variable on a 0..1 scale, ground first."""
    scaled = df.select(
        *keys, F.posexplode(unit_scale(ground_first(column, "dz"))).alias("level", "shade")
    )
    return scaled


def first_profile(df: DataFrame, order: Sequence[str] = ("time", "point_id")) -> DataFrame:
    """The first match in an explicit order; file order means nothing on a cluster."""
    return df.orderBy(*order).limit(1)


def preview(df: DataFrame, rows: int, order: Sequence[str] = ("time", "point_id")) -> DataFrame:
    """The first batch in an explicit order."""
    return df.orderBy(*order).limit(rows)
