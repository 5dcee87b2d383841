"""The composed queries: from stored samples to the table behind a chart.

Filters stand first, so they reach the scan and only the chosen rows are scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import HOUR
from ..operators.filters import at_point, at_site, between_times, deposition, scatter_points, slice_times
from ..operators.histograms import histogram
from ..operators.metrics import rmse
from ..operators.nets import CONV_NET, Net
from ..operators.series import fill_gaps, resample_sum
from ..operators.stats import Norm
from ..schema import DEFAULT_LAYERS, GROUP_COLS, TARGET
from .evaluation import score_samples

# Bins and range of the published distributions.
BINS, LOW, HIGH = 200, 0.0, 0.99


def with_error(df: DataFrame, scored: DataFrame) -> DataFrame:
    """Every row of ``df`` with the one error of all scored rows."""
    return df.join(scored.agg(rmse().alias("rmse")), how="cross")


def site_series(
    samples: DataFrame,
    norm: Norm,
    parameters,
    site: dict[str, float],
    start: str | datetime,
    end: str | datetime,
    net: Net = CONV_NET,
    step: timedelta = HOUR,
    layers: int = DEFAULT_LAYERS,
) -> DataFrame:
    """Target and prediction at a site: ``time, albedo, yhat, rmse``.

    Times without a sample, as at night, are rows of nulls, so lines break there.
    """
    chosen = between_times(at_site(samples, **site), start, end)
    scored = score_samples(chosen, norm, parameters, net, ("time",), layers)
    return with_error(fill_gaps(scored, "time", step), scored)


def prediction_distribution(
    samples: DataFrame,
    norm: Norm,
    parameters,
    geo: str,
    season: str,
    net: Net = CONV_NET,
    layers: int = DEFAULT_LAYERS,
    bins: int = BINS,
) -> DataFrame:
    """Counts of target and prediction over one season, and their error."""
    chosen = samples.where((F.col("geo") == geo) & (F.col("season") == season))
    scored = score_samples(chosen, norm, parameters, net, tuple(GROUP_COLS), layers)
    return with_error(histogram(scored, [TARGET, "yhat"], bins, LOW, HIGH), scored)


def scatter_with_margins(
    samples: DataFrame,
    norm: Norm,
    parameters,
    site: dict[str, float],
    net: Net = CONV_NET,
    keys: Sequence[str] = (),
    layers: int = DEFAULT_LAYERS,
    bins: int = BINS,
) -> tuple[DataFrame, DataFrame]:
    """(points, margins): target, prediction and surface density; counts of the first two."""
    chosen = at_site(samples, **site)
    scored = score_samples(chosen, norm, parameters, net, (*keys, "surface_density"), layers)
    points = scored.select(*keys, "surface_density", TARGET, "yhat")
    shown = scatter_points(points) if not keys else points.withColumnRenamed("yhat", "prediction")
    return shown, histogram(scored, [TARGET, "yhat"], bins, LOW, HIGH)


def point_deposition(
    fluxes: DataFrame, point_id: int, start: str | datetime, end: str | datetime
) -> DataFrame:
    """Monthly soot and dust at one point: ``month, soot_deposition, dust_deposition``."""
    inside = slice_times(at_point(fluxes, point_id), start, end)
    return resample_sum(deposition(inside), "time", ["soot_deposition", "dust_deposition"])
