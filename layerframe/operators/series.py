"""Regular series: gap filling and calendar resampling."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import exceeds_step, interval, micros, month_start, step_micros


def gaps(df: DataFrame, ts: str, step: timedelta, keys: Sequence[str] = ()) -> DataFrame:
    """Neighbouring sample times further apart than ``step``: ``keys..., a, b``.

    Samples are first reduced to the earliest and latest time of every
    step-wide slot.  Two neighbours inside a slot are never more than a step
    apart, so no gap is lost, and the window below sorts at most one row per
    slot and key however many samples a key holds.
    """
    slot = F.floor(micros(ts) / step_micros(step))
    slots = df.groupBy(*keys, slot.alias("_slot")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("a")
    )
    ordered = W.partitionBy(*keys).orderBy("_slot")
    following = slots.withColumn("b", F.lead("_first").over(ordered))
    return following.where(exceeds_step("a", "b", step)).select(*keys, "a", "b")


def fillers(df: DataFrame, ts: str, step: timedelta, keys: Sequence[str] = ()) -> DataFrame:
    """Times ``a + k * step`` strictly inside each gap, counted from its start."""
    inside = F.sequence(
        F.col("a") + interval(step),
        F.col("b") - interval(timedelta(microseconds=1)),
        interval(step),
    )
    return gaps(df, ts, step, keys).select(*keys, F.explode(inside).alias(ts))


def fill_gaps(
    df: DataFrame, ts: str, step: timedelta, keys: Sequence[str] = ()
) -> DataFrame:
    """The samples plus one row of nulls for every missing step between them."""
    extra = fillers(df, ts, step, keys)
    return df.unionByName(extra, allowMissingColumns=True)


def resample_sum(
    df: DataFrame, ts: str, columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Sums per calendar month; missing values are skipped, an empty month is 0.

    Empty months are generated from the month that precedes them, after
    aggregation, so the samples are read and shuffled once.
    """
    monthly = df.groupBy(*keys, month_start(ts).alias("_month")).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]
    )
    ordered = W.partitionBy(*keys).orderBy("_month")
    end = F.coalesce(
        F.lead("_month").over(ordered) - interval(timedelta(days=1)), F.col("_month")
    )
    spans = monthly.withColumn("_end", end)
    every = F.sequence(F.col("_month"), F.col("_end"), F.make_ym_interval(F.lit(0), F.lit(1)))
    filled = spans.select(*keys, "_month", *columns, F.explode(every).alias("month"))
    return filled.select(
        *keys,
        "month",
        *[
            F.when(F.col("month") == F.col("_month"), F.col(c)).otherwise(F.lit(0.0)).alias(c)
            for c in columns
        ],
    )
