"""Tables the queries write to the scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerframe.operators.joins import with_point_attrs
from layerframe.plans.ingest import to_sample_table
from layerframe.schema import FORCING_SCHEMA, PROFILE_SCHEMA, SAMPLE_SCHEMA
from layerframe.session import scratch_path
from layerframe.sources.inputs import write_inputs
from layerframe.sources.samples import write_samples

from . import views

KEY = T.StructField("sample_id", T.LongType(), True)
RAW_FORCING = T.StructType(
    [KEY, *[f for f in FORCING_SCHEMA if not f.name.startswith("imp_")]]
)
RAW_PROFILE = T.StructType([KEY, *PROFILE_SCHEMA])
KEYED_SAMPLES = T.StructType([KEY, *SAMPLE_SCHEMA])

_samples: dict[tuple[str, str], str] = {}


def raw_forcing(spark: SparkSession, sf: str) -> DataFrame:
    at = views.forcing_at_points(spark, sf)
    return at.select(*[F.col(f.name).cast(f.dataType) for f in RAW_FORCING])


def raw_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Layer stacks with the time, point and tile of their order."""
    heads = with_point_attrs(views.forcing(spark, sf), views.points(spark, sf)).select(
        "sample_id", "time", "point_id", "patch", "albedo", "geo", "season"
    )
    stacks = heads.join(views.profiles(spark, sf), "sample_id")
    return stacks.select(*[F.col(f.name).cast(f.dataType) for f in RAW_PROFILE])


def inputs(spark: SparkSession, sf: str) -> str:
    root = scratch_path(spark, "inputs")
    write_inputs(raw_forcing(spark, sf), raw_profile(spark, sf), root)
    return root


#: What is added to a point's number for each earlier order of the same time and point.
TWIN = 10_000_000


def _spread(df: DataFrame, twins: DataFrame) -> DataFrame:
    return df.join(twins, "sample_id").withColumn("point_id", F.col("point_id") + F.col("twin") * TWIN).drop("twin")


def unique_inputs(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Inputs of every order under a key of its own, and their points.

    Orders that share time and point are further points at the same place.
    """
    same = W.partitionBy("time", "point_id").orderBy("sample_id")
    twins = views.forcing(spark, sf).select("sample_id", (F.row_number().over(same) - 1).alias("twin"))
    root = scratch_path(spark, "unique-inputs")
    write_inputs(_spread(raw_forcing(spark, sf), twins), _spread(raw_profile(spark, sf), twins), root)
    points = views.points(spark, sf)
    used = views.forcing(spark, sf).join(twins, "sample_id").select("point_id", F.col("twin").alias("_twin")).distinct()
    spread = points.join(used, "point_id").withColumn("point_id", F.col("point_id") + F.col("_twin") * TWIN)
    return root, spread.drop("_twin")


def keyed_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The sample table plus the order number, which the comparisons need."""
    df = views.samples(spark, sf)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in KEYED_SAMPLES])


def samples(spark: SparkSession, sf: str) -> str:
    """The whole sample table, written once per session and scale."""
    memo = (spark.sparkContext.applicationId, sf)
    if memo not in _samples:
        root = scratch_path(spark, "samples")
        write_samples(keyed_samples(spark, sf), root)
        _samples[memo] = root
    return _samples[memo]


__all__ = ["KEYED_SAMPLES", "inputs", "raw_forcing", "raw_profile", "samples", "to_sample_table"]
