"""Pooled statistics: one mean and deviation per variable over all layers.

Layer values are read by position, as deep as each profile is, so the explode,
the array reads and the partial aggregation stay in one generated loop.  Moments are
kept as (n, mean, m2), which merge without cancellation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.layers import depth
from ..schema import GROUP_COLS, LAYER_VARS, STAT_VARS, SUN_VARS, TARGET


def layer_rows(df: DataFrame, by: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """One row per sample and layer it has; per-sample scalars are kept on layer 0 only.

    A sample without layers keeps one row.  ``also`` names columns to carry along.
    """
    scalars = [*SUN_VARS, TARGET]
    last = F.greatest(depth(*LAYER_VARS) - 1, F.lit(0))
    exploded = df.select(*by, *also, *LAYER_VARS, *scalars, F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return exploded.select(
        *by,
        *also,
        "at",
        *[F.get(v, F.col("at")).alias(v) for v in LAYER_VARS],
        *[F.when(F.col("at") == 0, F.col(v)).alias(v) for v in scalars],
    )


def moment_columns() -> list[Column]:
    """Aggregates over :func:`layer_rows` that :func:`moment_entries` reads."""
    out = [F.count_if(F.col("at") == 0).alias("n_rows")]
    for v in STAT_VARS:
        out += [
            F.count(v).alias(f"{v}_n"),
            F.avg(v).alias(f"{v}_mean"),
            F.var_pop(v).alias(f"{v}_var"),
        ]
    return out


def moment_entries() -> Column:
    """One (variable, n, mean, m2) per variable."""
    return F.array(*[
        F.struct(
            F.lit(v).alias("variable"),
            F.col(f"{v}_n").alias("n"),
            F.col(f"{v}_mean").alias("mean"),
            F.coalesce(F.col(f"{v}_var") * F.col(f"{v}_n"), F.lit(0.0)).alias("m2"),
        )
        for v in STAT_VARS
    ])


def partial_stats(df: DataFrame, by: Sequence[str] = tuple(GROUP_COLS)) -> DataFrame:
    """Count, sum and sum of squares per group and variable, absent layers left out.

    Returns ``by..., n_rows, variable, n, mean, m2, total, total_sq``; ``n_rows``
    is the number of samples the group was fitted on.
    """
    wide = layer_rows(df, by).groupBy(*by).agg(*moment_columns())
    return wide.select(*by, "n_rows", F.inline(moment_entries())).withColumns({
        "total": F.coalesce(F.col("mean") * F.col("n"), F.lit(0.0)),
        "total_sq": F.coalesce(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)),
    })


def merge_stats(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pool partial moments; the input has one row per stored unit and variable."""
    keys = [*by, "variable"]
    whole = W.partitionBy(*keys)
    centred = partials.withColumn(
        "centre",
        F.try_divide(
            F.sum(F.col("n") * F.col("mean")).over(whole), F.sum("n").over(whole).cast("double")
        ),
    )
    shift = F.col("mean") - F.col("centre")
    return centred.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("centre").alias("mean"),
        F.sum(F.col("m2") + F.coalesce(F.col("n") * shift * shift, F.lit(0.0))).alias("m2"),
    )


def finish_stats(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation from merged moments."""
    variance = F.try_divide(F.col("m2"), F.col("n").cast("double"))
    return moments.select(*by, "variable", "n", "mean", F.sqrt(variance).alias("std"))


def fit_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of the nine variables in one pass."""
    return finish_stats(partial_stats(df, by), by)


def stats_to_wide(stats: DataFrame) -> DataFrame:
    """The published layout of statistics: two rows, one column per variable."""
    entries = F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).alias("x")) for k in ("mean", "std")])
    long = stats.select("variable", F.inline(entries))
    return long.groupBy("statistic").pivot("variable", STAT_VARS).agg(F.first("x")).select("statistic", *STAT_VARS)


def stats_from_wide(wide: DataFrame) -> DataFrame:
    """Back to one row per variable: ``variable, mean, std``."""
    long = wide.unpivot("statistic", STAT_VARS, "variable", "x")
    return long.groupBy("variable").pivot("statistic", ["mean", "std"]).agg(F.first("x"))


@dataclass(frozen=True)
class Norm:
    """Fitted means and deviations, nine numbers each."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def from_stats(cls, stats: DataFrame) -> Norm:
        rows = stats.select("variable", "mean", "std").limit(len(STAT_VARS) + 1).collect()
        found = [r["variable"] for r in rows]
        if sorted(found) != sorted(STAT_VARS):
            raise ValueError(f"expected one row for each of {STAT_VARS}, got {found}")
        return cls(
            {r["variable"]: r["mean"] for r in rows}, {r["variable"]: r["std"] for r in rows}
        )

    @classmethod
    def from_wide(cls, wide: DataFrame) -> Norm:
        """From the published layout: rows ``mean`` and ``std``, a column per variable."""
        rows = {r["statistic"]: r for r in wide.select("statistic", *STAT_VARS).limit(3).collect()}
        if sorted(rows) != ["mean", "std"]:
            raise ValueError(f"expected the rows mean and std, got {sorted(rows)}")
        return cls(*({v: rows[name][v] for v in STAT_VARS} for name in ("mean", "std")))

    def scale(self, variable: str, value: Column) -> Column:
        """(x - mean) / std, NULL where the deviation is zero."""
        return F.try_divide(value - F.lit(self.mean[variable]), F.lit(self.std[variable]))
