"""Raw inputs: forcing, profile and point tables, and the pairing of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.names import profile_name, season_of_forcing
from ..operators.filters import clean_missing
from ..schema import FORCING_SCHEMA, GROUP_COLS, PROFILE_SCHEMA


# Hashing the hour along with the point keeps buckets even.
BUCKET_COLS = ["time", "point_id"]


def _open(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"nothing stored at {path}") from error


def read_inputs(
    spark: SparkSession,
    root: str,
    forcing_schema: T.StructType = FORCING_SCHEMA,
    profile_schema: T.StructType = PROFILE_SCHEMA,
    clean: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Forcing and profile tables below ``root``; both must exist.

    The schema is declared, so nothing is inferred.  NaN becomes NULL unless
    ``clean`` is off; the ingest plan filters first and cleans what is left.
    """
    forcing = _open(spark, f"{root}/forcing", forcing_schema)
    profile = _open(spark, f"{root}/profile", profile_schema)
    return (clean_missing(forcing), clean_missing(profile)) if clean else (forcing, profile)


def write_inputs(forcing: DataFrame, profile: DataFrame, root: str) -> None:
    """Store both inputs, one folder per region and season."""
    for name, df in (("forcing", forcing), ("profile", profile)):
        (
            df.hint("rebalance", *GROUP_COLS)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*GROUP_COLS)
            .parquet(f"{root}/{name}")
        )


def write_bucketed_inputs(
    forcing: DataFrame, profile: DataFrame, tables: tuple[str, str], buckets: int
) -> None:
    """Store both inputs as catalog tables bucketed alike on time and point.

    The join of the ingest plan then reads matching buckets side by side and
    shuffles neither input.  Joining on more columns than the buckets use needs
    ``spark.sql.requireAllClusterKeysForCoPartition`` off, as inside
    :func:`layerframe.session.co_partitioned`.
    """
    for name, df in zip(tables, (forcing, profile)):
        (
            df.repartition(buckets, *BUCKET_COLS)
            .write.mode("overwrite")
            .partitionBy(*GROUP_COLS)
            .bucketBy(buckets, *BUCKET_COLS)
            .sortBy(*BUCKET_COLS)
            .saveAsTable(name)
        )


def pair_inputs(files: DataFrame) -> DataFrame:
    """Work list from file names: ``geo, season, forcing, profile``.

    ``files`` lists ``geo, name`` of everything found.  A forcing file without
    its partner keeps a NULL ``profile``; see :func:`missing_partners`.
    """
    forcing = files.where(F.col("name").startswith("FORCING")).select(
        "geo",
        F.col("name").alias("forcing"),
        season_of_forcing("name").alias("season"),
        profile_name("name").alias("wanted"),
    )
    profile = files.where(F.col("name").startswith("PRO")).select(
        "geo", F.col("name").alias("profile")
    )
    paired = forcing.join(
        profile, (forcing["geo"] == profile["geo"]) & (forcing["wanted"] == profile["profile"]), "left"
    )
    return paired.select(forcing["geo"], "season", "forcing", "profile")


def missing_partners(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("profile").isNull()).select("geo", "season", "forcing")


def require_pairs(pairs: DataFrame) -> DataFrame:
    """Fail on an empty work list and on forcing files without a partner."""
    state = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("profile").isNull()).alias("alone")
    ).first()
    if not state["n"]:
        raise FileNotFoundError("the work list is empty")
    if state["alone"]:
        raise FileNotFoundError(f"{state['alone']} forcing files have no profile file")
    return pairs
