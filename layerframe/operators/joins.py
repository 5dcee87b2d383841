"""Joins between forcing, profiles, points and split plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layers import layer_count, ragged, surface, thickness
from ..functions.sun import cos_sza
from ..schema import GROUP_COLS, LAYER_VARS
from ..session import materialise


def sync_times(forcing: DataFrame, profile: DataFrame) -> DataFrame:
    """Forcing rows whose time also occurs in the profile table.

    The distinct times are written once, so Catalyst sees their real size when
    it chooses between a broadcast and a shuffled semi join.
    """
    times = materialise(profile.select("time").distinct(), "times")
    return forcing.join(times, "time", "left_semi")


def align(
    forcing: DataFrame, profile: DataFrame, on: tuple[str, ...] = ("time", "point_id")
) -> DataFrame:
    """Pair forcing and profile rows; the key is unique on both sides."""
    keep = [c for c in profile.columns if c in on or c not in forcing.columns]
    return forcing.join(profile.select(*keep), list(on), "inner")


def with_point_attrs(df: DataFrame, points: DataFrame) -> DataFrame:
    """Repeat the static attributes of each grid point over its rows.

    Points are numbered per region, so the region joins too where both have it.
    A row of a point that is not listed is an error.  How the sides meet is left
    to the optimizer, which knows their bytes.
    """
    keys = ["point_id"]
    if "geo" in df.columns and "geo" in points.columns:
        keys.append("geo")
    keep = [c for c in points.columns if c in keys or c not in df.columns]
    side = points.select(*keep, F.lit(True).alias(LISTED))
    unlisted = F.raise_error(F.concat(F.lit("no such point: "), F.col("point_id").cast("string")))
    listed = F.coalesce(F.col(LISTED), unlisted.cast("boolean"))
    return df.join(side, keys, "left").where(listed).drop(LISTED)


LISTED = "_listed"


def with_surface(df: DataFrame) -> DataFrame:
    """Drop what is absent at the arrays' ends; materialise the scalars that queries filter on.

    Profiles keep every layer they have, whatever their depth.
    """
    return df.withColumns({
        **{v: ragged(v) for v in LAYER_VARS},
        "surface_ssa": surface("ssa"),
        "surface_density": surface("density"),
        "surface_dust": surface("conc_dust"),
        "thickness": thickness("dz"),
        "n_layers": layer_count("dz"),
    })


def with_sun_angle(df: DataFrame) -> DataFrame:
    return df.withColumn("cos_sza", cos_sza("time", "lat", "lon", "slope", "aspect"))


def duplicate_keys(df: DataFrame, on: tuple[str, ...] = ("time", "point_id")) -> DataFrame:
    """Keys that occur more than once and would multiply rows in :func:`align`."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("copies"))
    return counts.where(F.col("copies") > 1)


def assign_split(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Label rows through their (geo, season) unit; units outside the plan go."""
    return df.join(plan, GROUP_COLS, "inner")
