"""The driver's tables seen as layered samples: points, forcing, layers, series.

Every view covers its whole tables, at the published depth of 50 layers.  The same definitions exist as DuckDB
common table expressions in :mod:`checks.sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layerframe.functions import times
from layerframe.operators.features import collect_layers
from layerframe.operators.joins import (
    assign_split,
    with_point_attrs,
    with_sun_angle,
    with_surface,
)
from layerframe.operators.splits import split_ratio
from layerframe.session import dealt
from layerframe.sources.samples import catalog

LAYERS = 50
SEED = 7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    key = F.col("c_custkey")
    flat = F.pmod(key, F.lit(3)) == 0
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("point_id"),
            F.col("r_name").alias("geo"),
            F.col("c_nationkey").alias("massif_number"),
            (F.pmod(key, F.lit(13)) * 300).cast("double").alias("zs"),
            F.when(flat, -1.0).otherwise(F.pmod(key, F.lit(8)) * 45.0).alias("aspect"),
            F.when(flat, 0.0).otherwise(F.pmod(key, F.lit(3)) * 20.0).alias("slope"),
            (F.pmod(key, F.lit(40)) / 10.0 + F.lit(42.0)).cast("double").alias("lat"),
            (F.pmod(key, F.lit(80)) / 10.0 - F.lit(1.0)).cast("double").alias("lon"),
        )
    )


def forcing(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order; the tile number is the digit of the order priority."""
    price = F.col("o_totalprice")
    y1 = times.season_start_year("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderdate").alias("time"),
        F.col("o_custkey").alias("point_id"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(price / 1000).alias("direct_sw"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 0.0)
        .otherwise(price / 2000)
        .alias("diffuse_sw"),
        (price / 500000).alias("albedo"),
        times.season_name(y1).alias("season"),
        F.month("o_orderdate").alias("month"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("patch"),
    )


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item, numbered within its order."""
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    ranked = dealt(table(spark, sf, "lineitem"), "l_orderkey").withColumn("layer", F.row_number().over(order))
    return ranked.select(
        F.col("l_orderkey").alias("sample_id"),
        "layer",
        (F.col("l_quantity") / 100).alias("dz"),
        (F.col("l_extendedprice") / 1000).alias("ssa"),
        (F.pmod("l_partkey", F.lit(100)) * 5.0 + 50.0).alias("density"),
        (F.col("l_discount") + 0.0).alias("conc_soot"),
        (F.col("l_tax") + 0.0).alias("conc_dust"),
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Layer arrays per order, with the snow mass that tells bare ground apart."""
    packed = collect_layers(layers(spark, sf), "sample_id")
    return packed.withColumn("swe", F.aggregate("dz", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))


def forcing_at_points(spark: SparkSession, sf: str) -> DataFrame:
    return with_point_attrs(dealt(forcing(spark, sf), "point_id"), points(spark, sf))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a sample; orders without line items are bare ground."""
    # Both sides grow with the data, so the smaller one is never worth a broadcast.
    stacks = profiles(spark, sf).hint("merge")
    joined = forcing_at_points(spark, sf).join(stacks, "sample_id", "left")
    return with_surface(with_sun_angle(joined))


def units(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(forcing_at_points(spark, sf))


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return split_ratio(units(spark, sf), 0.6, 0.2, seed=SEED)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with a made-up linear prediction."""
    return samples(spark, sf).withColumn(
        "yhat", F.col("albedo") * 0.9 + F.col("thickness") * 0.05
    )


def labelled_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return assign_split(predictions(spark, sf), plan(spark, sf))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """One series per user: mean value of each hour with events."""
    return (
        table(spark, sf, "events")
        .groupBy("user_id", times.hour_start("ts").alias("time"))
        .agg(F.avg("value").alias("value"))
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy("user_id", times.day_start("ts").alias("time"))
        .agg(F.avg("value").alias("value"))
    )


def fluxes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as impurity fluxes: the event type says which of the four it feeds."""
    def of(kind: str):
        return F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)

    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("point_id"),
        F.col("ts").alias("time"),
        of("click").alias("imp_dry1"),
        of("view").alias("imp_wet1"),
        of("purchase").alias("imp_dry2"),
        of("error").alias("imp_wet2"),
    )


def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log shape out of daily event averages: the day is the epoch."""
    def mean_of(kind: str):
        return F.coalesce(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))

    epoch = F.dayofyear("ts").cast("long")
    daily_means = table(spark, sf, "events").groupBy(epoch.alias("epoch")).agg(
        mean_of("click").alias("train_loss"),
        mean_of("view").alias("train_metric"),
        mean_of("purchase").alias("test_loss"),
        mean_of("error").alias("test_metric"),
    )
    rate = F.pow(F.lit(0.99), F.col("epoch") - 1) * 1e-4
    return daily_means.select(
        "epoch", rate.alias("learning_rate"), "train_loss", "train_metric", "test_loss", "test_metric"
    )
