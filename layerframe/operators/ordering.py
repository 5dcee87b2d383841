"""Row numbers, batches, shards and running sums without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import season_order
from ..session import materialise

# monotonically_increasing_id keeps the partition above this bit, the row below.
ROW_BITS = 33
RUN_LENGTH = 4096


def stored_order(*tail: str) -> list:
    """Units in season order, then the given columns inside a unit."""
    return [F.col("geo"), F.col("season"), season_order("month"), *[F.col(c) for c in tail]]


def number_rows(df: DataFrame, order: Sequence, column: str = "row_id") -> DataFrame:
    """Consecutive numbers from 0 in a total order.

    Rows are range-partitioned on the whole order, so a unit that holds a large
    share of the data spreads over many tasks.  The sorted rows are written once
    with their place inside the partition; afterwards only one count per
    partition is needed to turn places into global numbers.  ``order`` must end
    in a unique key.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(
        ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered"
    )
    part = F.shiftright("_place", ROW_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per written partition: a few thousand at most.
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    placed = stored.withColumn("_part", part).join(F.broadcast(starts), "_part")
    inside = F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    return placed.withColumn(column, F.col("_start") + inside).drop("_part", "_place", "_start")


def assign_batches(df: DataFrame, size: int, order: Sequence) -> DataFrame:
    """Batches of ``size`` consecutive rows; the last one may be smaller."""
    numbered = number_rows(df, order)
    return numbered.withColumn("batch_id", F.floor(F.col("row_id") / size))


def running_loss(batches: DataFrame) -> DataFrame:
    """Mean loss of all batches so far, after each batch.

    Batch numbers are dense, so runs of a fixed length split them evenly: totals
    per run are accumulated first and each run then sums its own batches.
    """
    weighted = batches.select(
        "batch_id",
        "n",
        "loss",
        F.floor(F.col("batch_id") / RUN_LENGTH).alias("_run"),
        (F.col("loss") * F.col("n")).alias("_weighted"),
    )
    totals = weighted.groupBy("_run").agg(
        F.sum("_weighted").alias("_run_loss"), F.sum("n").alias("_run_n")
    )
    before = W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "_run",
        F.coalesce(F.sum("_run_loss").over(before), F.lit(0.0)).alias("_loss_before"),
        F.coalesce(F.sum("_run_n").over(before), F.lit(0)).alias("_n_before"),
    )
    so_far = W.partitionBy("_run").orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    running = weighted.withColumns({
        "_loss_here": F.sum("_weighted").over(so_far),
        "_n_here": F.sum("n").over(so_far),
    })
    return running.join(starts, "_run").select(
        "batch_id",
        "n",
        "loss",
        (
            (F.col("_loss_before") + F.col("_loss_here"))
            / (F.col("_n_before") + F.col("_n_here"))
        ).alias("running_loss"),
    )


def rank_units(units: DataFrame, order: Sequence) -> DataFrame:
    """Number the stored units from 0; a catalog is small by nature."""
    return units.withColumn("unit", F.row_number().over(W.orderBy(*order)) - 1)


def assign_shards(units: DataFrame, workers: int, order: Sequence | None = None) -> DataFrame:
    """Contiguous shards of ceil(n / workers) units; trailing workers may get none."""
    if workers < 1:
        raise ValueError("at least one worker is needed")
    ranked = rank_units(units, order or stored_order())
    per_worker = max(1, math.ceil(units.count() / workers))
    return ranked.withColumn("shard", F.floor(F.col("unit") / per_worker))


def shuffle_units(units: DataFrame, seed: int, by: Sequence[str] = ("geo", "season")) -> DataFrame:
    """A reproducible random order: the digest of seed and unit name."""
    digest = F.md5(F.concat(F.lit(str(seed)), *[F.col(c).cast("string") for c in by]))
    return units.withColumn("digest", digest).orderBy("digest", *by)


def by_season_order(df: DataFrame, month: str = "month") -> DataFrame:
    return df.orderBy(season_order(month))
