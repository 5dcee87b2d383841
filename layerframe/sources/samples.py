"""The persisted sample table, its catalog and its description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clustering import site_order
from ..functions.names import is_season
from ..functions.times import micros, season_order
from ..schema import (
    GROUP_COLS,
    ID_LABELS,
    SAMPLE_SCHEMA,
    UNIT_COLS,
    VARIABLE_LABELS,
)
from .ledger import append, commit_folder, new_commit, next_version, read_current, summarise, units

# What a look-up names besides the unit.
SITE_COLS = ["massif_number", "zs", "slope", "aspect"]


def read_samples(
    spark: SparkSession, root: str, schema: T.StructType = SAMPLE_SCHEMA
) -> DataFrame:
    """All stored units as one table; filters on it prune folders and row groups.

    The ledger says which folders are current; only those are listed.
    """
    return read_current(spark, root, schema)


def write_samples(df: DataFrame, root: str, clustering: str = "site") -> None:
    """One folder per region, season and month, replacing those seasons.

    Rows inside a unit are sorted by site, the first column first, which reads
    least where look-ups name the massif; ``interleaved`` sorts by the bits of all
    four in turn, which reads less where they name only an altitude or an aspect.
    A Bloom filter per row group lets look-ups of a point skip.  The rebalance
    hint sizes the output files: small units are merged, and a
    unit that holds much of the data is split over several tasks.  What is known
    of each unit is taken from the files written, and appended to the ledger
    last: until then nothing is visible, and a month that an earlier commit
    stored for one of these seasons but this one did not is gone with it.
    Seasons that are not in ``df`` are never touched, whoever writes to them.
    """
    spark = df.sparkSession
    commit, version = new_commit(), next_version(spark, root)
    if clustering not in ("site", "interleaved"):
        raise ValueError("clustering must be site or interleaved")
    sort = [F.col(c) for c in (*SITE_COLS, "time") if c in df.columns]
    if clustering == "interleaved":
        sort.insert(0, site_order())
    folder = commit_folder(root, commit)
    (
        df.hint("rebalance", *UNIT_COLS)
        .sortWithinPartitions(*UNIT_COLS, *sort)
        .write.partitionBy(*UNIT_COLS)
        .option("parquet.bloom.filter.enabled#point_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(folder)
    )
    # sort order of the columns, types and labels as written
    written = spark.read.schema(df.schema).parquet(folder)
    append(summarise(written), root, version, commit)


def catalog(df: DataFrame, level: str = "unit") -> DataFrame:
    """Stored units: flat, grouped by season, or grouped by region then season.

    ``df`` is any table with the unit columns; given those of
    :func:`layerframe.sources.ledger.units`, no sample is read.
    """
    units = df.select(*UNIT_COLS).distinct()
    if level == "unit":
        return units
    ordered = F.array_sort(
        F.collect_list(F.struct(season_order("month").alias("at"), F.col("month")))
    )
    seasons = (
        units.groupBy(*GROUP_COLS)
        .agg(ordered.alias("_months"))
        .select(*GROUP_COLS, F.col("_months.month").alias("months"))
    )
    if level == "season":
        return seasons
    if level == "geo":
        nested = F.array_sort(F.collect_list(F.struct("season", "months")))
        return seasons.groupBy("geo").agg(nested.alias("seasons"))
    raise ValueError("level must be unit, season or geo")


def scan_units(df: DataFrame) -> DataFrame:
    """Rows per stored unit; with partition columns only, no data page is read."""
    return df.groupBy(*UNIT_COLS).agg(F.count(F.lit(1)).alias("n"))


def season_units(df: DataFrame, geo: str, season: str) -> DataFrame:
    """Rows of one season; an unknown region, a bad name or no data is an error."""
    state = (
        df.where(F.col("geo") == geo)
        .agg(
            F.count(F.lit(1)).alias("in_geo"),
            F.count_if(F.col("season") == season).alias("in_season"),
            F.any_value(is_season(F.lit(season))).alias("named"),
        )
        .first()
    )
    if not state["in_geo"]:
        raise ValueError(f"unknown region {geo!r}")
    if not state["named"]:
        raise ValueError(f"season must look like 1979_1980, not {season!r}")
    if not state["in_season"]:
        raise ValueError(f"no data for {geo} {season}")
    return df.where((F.col("geo") == geo) & (F.col("season") == season))


def read_season(
    spark: SparkSession, root: str, geo: str, season: str, schema: T.StructType = SAMPLE_SCHEMA
) -> DataFrame:
    """Rows of one season; its arguments are checked against the ledger, and only its folder is listed."""
    chosen = season_units(units(spark, root), geo, season)
    return read_current(spark, root, schema, chosen)


def describe_selection(df: DataFrame) -> DataFrame:
    """The regions and seasons in a selection, one row each."""
    years = F.split("season", "_")
    return (
        df.select(*GROUP_COLS)
        .distinct()
        .select("geo", years[0].alias("y1"), years[1].alias("y2"))
        .orderBy("geo", "y1")
    )


def with_metadata(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Attach a label to each column; Parquet files keep it in their schema."""
    labels = {**VARIABLE_LABELS, **ID_LABELS, "zs": ID_LABELS["ZS"], **(labels or {})}
    return df.select(*[
        F.col(c).alias(c, metadata={"label": labels[c]}) if c in labels else F.col(c)
        for c in df.columns
    ])


def labels_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["label"] for f in df.schema.fields if "label" in f.metadata}


def manifest(df: DataFrame, description: str, sources: dict[str, str], run: dict[str, str]) -> DataFrame:
    """One row that describes the table: sources, run identifiers, time coverage and step.

    ``resolution`` is the smallest step between two times of one season, in seconds.
    """
    def literal(values: dict[str, str]):
        pairs = [F.lit(x) for item in sorted(values.items()) for x in item]
        return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")

    seasons = W.partitionBy(*[c for c in GROUP_COLS if c in df.columns]).orderBy("time")
    times = df.select(*[c for c in GROUP_COLS if c in df.columns], "time").distinct()
    step = (micros("time") - micros(F.lag("time").over(seasons))) / 1e6
    steps = times.select(step.alias("step")).agg(F.min("step").alias("resolution"))
    return df.agg(
        F.lit(description).alias("description"),
        literal(sources).alias("sources"),
        literal(run).alias("run"),
        F.min("time").alias("start"),
        F.max("time").alias("end"),
        F.count(F.lit(1)).alias("n"),
    ).join(steps, how="cross")


MANIFEST = "_manifest"


def write_manifest(described: DataFrame, root: str) -> None:
    """Keep a manifest with its table; Spark passes over names with an underscore."""
    described.repartition(1).write.mode("overwrite").parquet(f"{root}/{MANIFEST}")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{MANIFEST}")
