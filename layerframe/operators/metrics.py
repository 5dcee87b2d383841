"""Error measures and evaluation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TARGET


def _error(y: str, yhat: str) -> Column:
    return F.col(y).cast("double") - F.col(yhat).cast("double")


def mse(y: str = TARGET, yhat: str = "yhat") -> Column:
    error = _error(y, yhat)
    return F.avg(error * error)


def mae(y: str = TARGET, yhat: str = "yhat") -> Column:
    return F.avg(F.abs(_error(y, yhat)))


def rmse(y: str = TARGET, yhat: str = "yhat") -> Column:
    return F.sqrt(mse(y, yhat))


def evaluate(
    df: DataFrame, by: Sequence[str] = ("split",), y: str = TARGET, yhat: str = "yhat"
) -> DataFrame:
    """Rows, MSE, MAE and RMSE per group in one partially aggregated pass."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        mse(y, yhat).alias("mse"),
        mae(y, yhat).alias("mae"),
        rmse(y, yhat).alias("rmse"),
    )


def batch_losses(
    df: DataFrame, batch: str = "batch_id", y: str = TARGET, yhat: str = "yhat"
) -> DataFrame:
    """Mean squared error and size of every batch."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), mse(y, yhat).alias("loss"))


def mean_loss(batches: DataFrame) -> DataFrame:
    """Batch losses averaged with the batch sizes as weights."""
    return batches.agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("mean_loss")
    )


def best_trial(trials: DataFrame, objective: str = "value") -> DataFrame:
    """The trial with the smallest objective, all its columns kept."""
    whole = F.struct(*trials.columns)
    return trials.agg(F.min_by(whole, F.col(objective)).alias("best")).select("best.*")
