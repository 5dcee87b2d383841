"""Row filters and projections.

Each function is ``DataFrame -> DataFrame`` and fits ``df.transform``.  Plain
comparisons on stored columns are separate conjuncts so that they reach the
Parquet scan.  Spark orders NaN above every number, so a sign test must rule it
out; where NaN can occur at all, :func:`clean_missing` turns it into NULL once,
after these filters have cut the rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layers import nan_layers_to_null, nan_to_null
from ..functions.times import iso_string, ntz
from ..schema import ID_VARS, TARGET

SECONDS_PER_HOUR = 3600


def clean_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column and layer array."""
    cleaned = []
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            cleaned.append(nan_to_null(field.name).alias(field.name))
        elif isinstance(kind, T.ArrayType) and isinstance(
            kind.elementType, (T.DoubleType, T.FloatType)
        ):
            cleaned.append(nan_layers_to_null(field.name).alias(field.name))
        else:
            cleaned.append(F.col(field.name))
    return df.select(*cleaned)


def prune(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the named columns; anything else is dropped at the scan."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*columns)


def drop_unneeded(df: DataFrame, needed: list[str]) -> DataFrame:
    """Drop every column that is not in ``needed``; names in it may be absent."""
    return df.drop(*sorted(set(df.columns) - set(needed)))


def by_month(df: DataFrame, month: int, ts: str = "time") -> DataFrame:
    if month not in range(1, 13):
        raise ValueError(f"no such month: {month}")
    return df.where(F.month(ts) == month)


def first_patch(df: DataFrame) -> DataFrame:
    return df.where(F.col("patch") == 0)


def has_snow(df: DataFrame, swe: str = "swe") -> DataFrame:
    return df.where((F.col(swe) > 0) & ~F.isnan(swe))


def is_daytime(df: DataFrame, direct: str = "direct_sw", diffuse: str = "diffuse_sw") -> DataFrame:
    """Any radiation at all.  The first condition is the part a scan can apply."""
    a, b = F.col(direct), F.col(diffuse)
    return df.where((a > 0) | (b > 0)).where(
        ((a > 0) & ~F.isnan(a)) | ((b > 0) & ~F.isnan(b))
    )


def at_site(
    df: DataFrame,
    massif: int,
    zs: float | None = None,
    slope: float | None = None,
    aspect: float | None = None,
) -> DataFrame:
    """One site; flat ground is slope 0 together with aspect -1."""
    wanted = {"massif_number": massif, "zs": zs, "slope": slope, "aspect": aspect}
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def at_point(df: DataFrame, point_id: int) -> DataFrame:
    return df.where(F.col("point_id") == point_id)


def between_times(
    df: DataFrame, start: str | datetime, end: str | datetime, ts: str = "time"
) -> DataFrame:
    """Half-open range: ``start`` is in, ``end`` is not."""
    return df.where((F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end)))


def at_time_of_day(df: DataFrame, clock: str, ts: str = "time") -> DataFrame:
    """Rows whose clock reads ``HH:MM:SS``, fractions of a second aside."""
    hour, minute, second = (int(part) for part in clock.split(":"))
    return df.where(
        (F.hour(ts) == hour) & (F.minute(ts) == minute) & (F.second(ts) == second)
    )


def slice_times(
    df: DataFrame, start: str | datetime, end: str | datetime, ts: str = "time"
) -> DataFrame:
    """Closed range; the data must reach strictly beyond both of its ends."""
    inside = df.agg(
        (F.min(ts) < ntz(start)).alias("before"), (F.max(ts) > ntz(end)).alias("after")
    ).first()
    if not (inside["before"] and inside["after"]):
        raise ValueError("the data must extend beyond both ends of the slice")
    return df.where(F.col(ts).between(ntz(start), ntz(end)))


def find_profiles(df: DataFrame, max_surface_ssa: float, min_albedo: float) -> DataFrame:
    """Profiles with a coarse-grained surface that are bright all the same."""
    return df.where((F.col("surface_ssa") <= max_surface_ssa) & (F.col(TARGET) >= min_albedo))


def id_columns(df: DataFrame) -> list[Column]:
    """The published identifier columns: time as text, massif as integer."""
    del df
    return [
        iso_string("time").alias("time"),
        F.col("zs").cast("double").alias("ZS"),
        F.col("aspect").cast("double").alias("aspect"),
        F.col("slope").cast("double").alias("slope"),
        F.col("massif_number").cast("int").alias("massif_number"),
    ]


def identify(df: DataFrame) -> DataFrame:
    return df.select(*id_columns(df)).select(*ID_VARS)


def scatter_points(df: DataFrame, prediction: str = "yhat") -> DataFrame:
    """Target, prediction and the surface density that colours the point."""
    return df.select(TARGET, F.col(prediction).alias("prediction"), "surface_density")


def deposition(df: DataFrame) -> DataFrame:
    """Hourly deposition of soot (1) and dust (2) from fluxes per second."""
    def flux(kind: int) -> Column:
        return (F.col(f"imp_dry{kind}") + F.col(f"imp_wet{kind}")) * SECONDS_PER_HOUR

    return df.withColumns({"soot_deposition": flux(1), "dust_deposition": flux(2)})
