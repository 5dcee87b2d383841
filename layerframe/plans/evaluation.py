"""From a sample table to a scored, labelled table and its error report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import assign_split
from ..operators.metrics import evaluate
from ..operators.nets import CONV_NET, Net
from ..operators.scoring import score_profiles
from ..operators.stats import Norm, finish_stats, fit_stats, merge_stats
from ..schema import DEFAULT_LAYERS, LAYER_VARS, SUN_VARS, TARGET
from ..sources.ledger import stored_moments, units


def fit_norm(samples: DataFrame, plan: DataFrame, split: str = "train") -> Norm:
    """Normalisation fitted on the units of one split only."""
    chosen = assign_split(samples, plan.where(F.col("split") == split))
    return Norm.from_stats(fit_stats(chosen))


def fit_stored_norm(spark: SparkSession, root: str, plan: DataFrame, split: str = "train") -> Norm:
    """:func:`fit_norm` of a stored table, merged from its ledger: no sample is read."""
    chosen = assign_split(units(spark, root), plan.where(F.col("split") == split))
    return Norm.from_stats(finish_stats(merge_stats(stored_moments(chosen))))


def score_samples(
    samples: DataFrame,
    norm: Norm,
    parameters,
    net: Net = CONV_NET,
    keys: tuple[str, ...] = (),
    layers: int = DEFAULT_LAYERS,
) -> DataFrame:
    """Prediction per sample from its stored arrays; ``keys`` and the target are kept."""
    kept = list(dict.fromkeys((*keys, TARGET)))
    needed = [c for c in (*LAYER_VARS, *SUN_VARS) if c not in kept]
    return score_profiles(samples.select(*kept, *needed), norm, net, parameters, layers).select(*kept, "yhat")


def report(
    samples: DataFrame,
    plan: DataFrame,
    parameters,
    net: Net = CONV_NET,
    layers: int = DEFAULT_LAYERS,
) -> DataFrame:
    """MSE, MAE and RMSE per split, normalised with train statistics."""
    norm = fit_norm(samples, plan)
    labelled = assign_split(samples, plan)
    return evaluate(score_samples(labelled, norm, parameters, net, ("split",), layers))


def report_models(
    samples: DataFrame,
    plan: DataFrame,
    norm: Norm,
    models: dict[str, tuple[Net, list]],
    layers: int = DEFAULT_LAYERS,
) -> DataFrame:
    """``model, split, n, mse, mae, rmse``: every model over the same rows, read once.

    The models' predictions stand side by side, so no two of them see other rows.
    """
    scored = assign_split(samples, plan).select("split", TARGET, *[c for c in (*LAYER_VARS, *SUN_VARS)])
    for name, (net, parameters) in models.items():
        scored = score_profiles(scored, norm, net, parameters, layers, f"_{name}")
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_{n}").alias("yhat")) for n in models])
    return evaluate(scored.select("split", TARGET, F.inline(pairs)), by=("model", "split"))
