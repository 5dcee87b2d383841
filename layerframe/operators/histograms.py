"""Histograms with numpy bin semantics: the last bin is closed on the right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import linear_edges, log_edges


def _settle(guess: Column, x: Column, edges: list[float]) -> Column:
    """Move a guessed bin by at most one so that it agrees with the edges exactly."""
    last = len(edges) - 2
    table = F.lit(edges)
    at = F.greatest(F.lit(0), F.least(F.lit(last), guess.cast("int")))
    down = F.when(x < F.get(table, at), 1).otherwise(0)
    up = F.when((x >= F.get(table, at + 1)) & (at < last), 1).otherwise(0)
    return at - down + up


def _counts(df: DataFrame, columns: Sequence[str], index, edges_of: dict[str, list[float]]):
    """Count per variable and bin in one scan; bins nobody fell into are listed with 0."""
    spark = df.sparkSession
    entries = []
    for name in columns:
        x = F.col(name).cast("double")
        edges = edges_of[name]
        inside = (x >= edges[0]) & (x <= edges[-1])
        entries.append(
            F.struct(
                F.lit(name).alias("variable"),
                F.when(inside, _settle(index(x, edges), x, edges)).alias("bin"),
            )
        )
    hits = (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("bin").isNotNull())
        .groupBy("variable", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    rows = [
        (name, i, low, high)
        for name in columns
        for i, (low, high) in enumerate(zip(edges_of[name], edges_of[name][1:]))
    ]
    bins = spark.createDataFrame(rows, "variable string, bin int, low double, high double")
    # The counts hold at most one row per bin, the same rows as the bin list.
    listed = bins.join(F.broadcast(hits), ["variable", "bin"], "left")
    return listed.select(
        "variable", "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count")
    )


def _span(low: float, high: float) -> tuple[float, float]:
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def histogram(
    df: DataFrame,
    columns: str | Sequence[str],
    bins: int,
    low: float | None = None,
    high: float | None = None,
    ends: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Equal-width counts on [low, high], or on each column's own range.

    ``ends`` gives the ranges where they are known, as
    :func:`layerframe.sources.ledger.stored_spans` knows them of whole units:
    the rows are then scanned once, not twice.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    if ends is not None:
        spans = {c: _span(*ends.get(c, (0.0, 1.0))) for c in columns}
    elif low is None or high is None:
        ends = df.agg(
            *[F.struct(F.min(c), F.max(c)).alias(c) for c in columns]
        ).first()
        spans = {c: _span(*(float(v) for v in (ends[c] if ends[c][0] is not None else (0, 1))))
                 for c in columns}
    else:
        spans = {c: _span(float(low), float(high)) for c in columns}
    edges_of = {c: linear_edges(*spans[c], bins) for c in columns}

    def index(x: Column, edges: list[float]) -> Column:
        return F.floor((x - edges[0]) / (edges[-1] - edges[0]) * bins)

    return _counts(df, columns, index, edges_of)


def log_histogram(
    df: DataFrame, column: str, low_exponent: float, high_exponent: float, edge_count: int
) -> DataFrame:
    """Counts between ``edge_count`` edges evenly spaced in log10; zeros fall outside."""
    edges = log_edges(low_exponent, high_exponent, edge_count)
    per_decade = (edge_count - 1) / (high_exponent - low_exponent)

    def index(x: Column, _: list[float]) -> Column:
        return F.floor((F.log10(x) - low_exponent) * per_decade)

    return _counts(df, [column], index, {column: edges})
