"""Regression on feature columns and a grid search over its settings."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import GROUP_COLS, TARGET
from ..session import materialise
from .metrics import best_trial, mse
from .ordering import shuffle_units

KINDS = {"linear": LinearRegression, "gbt": GBTRegressor}
VECTOR = "features"
PREDICTION = "yhat"


def with_vector(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    """An ML vector from one array column or from several scalar columns.

    A NULL or NaN scalar is an error: no row leaves a fit or a report silently.
    """
    if isinstance(features, str):
        return df.withColumn(VECTOR, array_to_vector(F.col(features).cast("array<double>")))
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error")
    return assembler.transform(df)


def regressor(target: str = TARGET, kind: str = "linear", **settings):
    return KINDS[kind](
        featuresCol=VECTOR, labelCol=target, predictionCol=PREDICTION, **settings
    )


def fit_regressor(
    train: DataFrame,
    features: str | Sequence[str],
    target: str = TARGET,
    kind: str = "linear",
    **settings,
) -> Model:
    """Fit on the rows of the train split; Spark ML distributes the work."""
    return regressor(target, kind, **settings).fit(with_vector(train, features))


def predict_with(model: Model, df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    return model.transform(with_vector(df, features))


def sweep(
    train: DataFrame,
    val: DataFrame,
    features: str | Sequence[str],
    grid: dict[str, Sequence],
    target: str = TARGET,
    kind: str = "linear",
    parallelism: int = 2,
) -> DataFrame:
    """One trial per grid point: ``trial, <parameters...>, value`` (MSE on ``val``).

    Validation rows come from their own seasons, not from a random row sample,
    so neighbouring hours of one profile never sit on both sides.
    """
    points = _grid(grid)
    rows = _tried(train, val, features, list(enumerate(points)), target, kind, parallelism)
    return _trial_table(train, grid, points, [(number, value) for number, value in rows])


def halving(
    train: DataFrame,
    val: DataFrame,
    features: str | Sequence[str],
    grid: dict[str, Sequence],
    rungs: int,
    factor: int = 2,
    seed: int = 0,
    target: str = TARGET,
    kind: str = "linear",
    parallelism: int = 2,
) -> DataFrame:
    """Successive halving: ``rung, n_groups, trial, <parameters...>, value``, survivors on ever more seasons.

    Rung 0 fits every grid point on few (geo, season) groups of ``train``, taken
    in a seeded order; each next rung has ``factor`` times the groups, the last
    all of them, and only the best 1 / ``factor`` of the points, ties to the
    smaller number.  Every rung is measured on the whole of ``val``.  What the
    driver holds is one row per trial.
    """
    if rungs < 1 or factor < 2:
        raise ValueError("at least one rung and a factor of two")
    points = _grid(grid)
    # one row per season: as small as the catalog
    groups = materialise(shuffle_units(train.select(*GROUP_COLS).distinct(), seed), "season-order")
    total = groups.count()
    alive, out = list(enumerate(points)), []
    for rung in range(rungs):
        taken = -(-total // factor ** (rungs - 1 - rung))
        chosen = groups.orderBy("digest", *GROUP_COLS).limit(taken).select(*GROUP_COLS)
        rows = train if taken == total else train.join(chosen, GROUP_COLS, "left_semi")
        tried = _tried(rows, val, features, alive, target, kind, parallelism)
        out += [(rung, taken, number, value) for number, value in tried]
        best = sorted(tried, key=lambda t: (t[1], t[0]))[: -(-len(tried) // factor)]
        alive = sorted((number, points[number]) for number, _ in best)
    table = _trial_table(train, grid, points, [(number, value) for _, _, number, value in out])
    at = train.sparkSession.createDataFrame(out, "rung int, n_groups int, trial int, value double")
    return at.join(table.drop("value").distinct(), "trial").select("rung", "n_groups", "trial", *grid, "value")


def _grid(grid: dict[str, Sequence]) -> list[dict]:
    """Every combination, the last axis fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _tried(train, val, features, points, target, kind, parallelism) -> list[tuple[int, float]]:
    """(number, error on ``val``) of each numbered grid point fitted on ``train``."""
    from concurrent.futures import ThreadPoolExecutor

    train_rows = with_vector(train, features).select(VECTOR, target).persist()
    val_rows = with_vector(val, features).select(VECTOR, target).persist()

    def trial(item):
        number, settings = item
        model = regressor(target, kind, **settings).fit(train_rows)
        error = model.transform(val_rows).agg(mse(target, PREDICTION).alias("value")).first()
        return number, error["value"]

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            return list(pool.map(trial, points))
    finally:
        train_rows.unpersist()
        val_rows.unpersist()


def _trial_table(df: DataFrame, grid: dict[str, Sequence], points: list[dict], rows: list[tuple[int, float]]) -> DataFrame:
    casts = {name: CASTS[_kind(values)] for name, values in grid.items()}
    kinds = [f"`{name}` {_kind(values)}" for name, values in grid.items()]
    full = [(number, *[casts[name](points[number][name]) for name in grid], value) for number, value in rows]
    return df.sparkSession.createDataFrame(full, ", ".join(["trial int", *kinds, "value double"]))


CASTS = {"boolean": bool, "long": int, "double": float, "string": str}


def _kind(values: Sequence) -> str:
    """SQL type of a setting, from the values on its axis of the grid."""
    for python, name in ((bool, "boolean"), (int, "long"), (float, "double")):
        if all(type(v) is python for v in values):
            return name
    return "double" if all(isinstance(v, (int, float)) for v in values) else "string"


__all__ = ["best_trial", "fit_regressor", "halving", "predict_with", "regressor", "sweep", "with_vector"]
