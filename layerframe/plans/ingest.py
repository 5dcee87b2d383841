"""From forcing and profile tables to stored samples, as one job over all seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import clean_missing, first_patch, has_snow, is_daytime
from ..operators.joins import align, duplicate_keys, with_point_attrs, with_sun_angle, with_surface
from ..schema import GROUP_COLS, SAMPLE_SCHEMA
from ..sources.inputs import read_inputs
from ..sources.samples import manifest, read_samples, with_metadata, write_manifest, write_samples

# Points are numbered per region, and the hour in which one season ends and the
# next begins is present in both: region and season belong to the key.
STORED_KEY = ("time", "point_id", "geo", "season")


def build_samples(
    forcing: DataFrame,
    profile: DataFrame,
    points: DataFrame,
    on: tuple[str, ...] = ("time", "point_id"),
) -> DataFrame:
    """Daytime rows with snow on the ground, sun angle and surface scalars added.

    Both inputs are filtered at the scan and cleaned before they meet.  The join on (time, point) also
    keeps only times that occur on both sides, so no separate synchronisation
    pass is needed.  The month is the month of the time stamp, the season comes
    from the input.
    """
    lit = clean_missing(is_daytime(forcing))
    snowy = clean_missing(first_patch(has_snow(profile))).drop("patch")
    joined = with_point_attrs(align(lit, snowy, on), clean_missing(points))
    return with_surface(with_sun_angle(joined)).withColumn("month", F.month("time"))


def to_sample_table(df: DataFrame) -> DataFrame:
    """Exactly the stored columns, in stored order and type."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in SAMPLE_SCHEMA.fields])


def require_paired_seasons(forcing: DataFrame, profile: DataFrame) -> None:
    """Fail when a region and season has rows on one side only."""
    sides = (forcing.select(*GROUP_COLS).distinct(), profile.select(*GROUP_COLS).distinct())
    for a, b, name in ((*sides, "profile"), (*sides[::-1], "forcing")):
        alone = a.join(b, GROUP_COLS, "left_anti").first()
        if alone is not None:
            raise FileNotFoundError(f"{alone['geo']} {alone['season']} has no {name} rows")


def require_unique(df: DataFrame, on: tuple[str, ...], name: str) -> None:
    """Fail when a key occurs twice: the join would multiply its rows."""
    twice = duplicate_keys(df, on).first()
    if twice is not None:
        raise ValueError(f"{name} rows repeat the key {twice.asDict()}")


def ingest(
    spark: SparkSession,
    inputs: str,
    points: DataFrame,
    out: str,
    description: str = "layered samples",
    run: dict[str, str] | None = None,
    on: tuple[str, ...] = STORED_KEY,
) -> None:
    """Read, check, build and store every season below ``inputs``, with a manifest.

    Seasons must have both inputs, and keys be unique on each side, among the
    rows that meet in the join.
    """
    forcing, profile = read_inputs(spark, inputs, clean=False)
    require_paired_seasons(forcing, profile)
    require_unique(forcing, on, "forcing")
    require_unique(first_patch(has_snow(profile)), on, "profile")
    samples = build_samples(forcing, profile, points, on)
    write_samples(with_metadata(to_sample_table(samples)), out)
    sources = {"forcing": f"{inputs}/forcing", "profile": f"{inputs}/profile"}
    write_manifest(manifest(read_samples(spark, out), description, sources, run or {}), out)
