"""Batch scoring: one prediction per row with a fixed model."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layers import MAX_DEPTH
from ..functions.maths import sigmoid
from ..schema import LAYER_VARS, SUN_VARS
from . import nets
from .nets import Net, check_parameters, predict
from .stats import Norm

# Workers receive the forward pass with the task, not from an installed package.
cloudpickle.register_pickle_by_value(nets)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


PARAMETER_SCHEMA = "layer int, kind string, position long, value double"


def save_parameters(spark: SparkSession, parameters, path: str) -> None:
    """Weights as a table, one row per number."""
    rows = spark.createDataFrame(nets.parameters_to_rows(parameters), PARAMETER_SCHEMA)
    rows.write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str, net: Net, layers: int, dtype: str = "float32"):
    """Weights of a stored model, checked against the shapes of ``net``.

    Their number is bounded by the network, not by any data.
    """
    stored = spark.read.schema(PARAMETER_SCHEMA).parquet(path)
    return nets.parameters_from_rows(net, layers, (tuple(r) for r in stored.toLocalIterator()), dtype)


def score_dense(
    df: DataFrame, features: str, weights: list[float], bias: float, column: str = "yhat",
    output: str = "sigmoid",
) -> DataFrame:
    """One dense layer over a feature vector, entirely inside the JVM."""
    products = F.zip_with(
        F.col(features), F.lit([float(w) for w in weights]), lambda x, w: x.cast("double") * w
    )
    total = F.aggregate(products, F.lit(float(bias)), lambda acc, x: acc + x)
    return df.withColumn(column, sigmoid(total) if output == "sigmoid" else total)


def score(
    df: DataFrame,
    net: Net,
    parameters: list[tuple[np.ndarray, np.ndarray]],
    layers: int,
    snow: str = "x_snow",
    scalars: str = "x_sun",
    column: str = "yhat",
    dtype: str = "float32",
) -> DataFrame:
    """Score rows with a convolutional or flat network.

    Only the two feature columns travel to the Python workers; every other
    column waits in the JVM.  The weights are broadcast once per executor.
    """
    check_parameters(net, layers, parameters)
    shipped = df.sparkSession.sparkContext.broadcast(
        [(w.astype(dtype), b.astype(dtype)) for w, b in parameters]
    )
    convolutional = bool(net.stages)
    width = parameters[-len(net.dense) - 1][0].shape[1] if not convolutional else net.scalars
    depth, channels = layers, net.channels

    def rows_of(column: pa.Array, *shape: int) -> np.ndarray:
        while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            column = column.flatten()
        return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, *shape)

    def finish(values: np.ndarray) -> pa.Array:
        return pa.array(values.astype("float64"), mask=np.isnan(values))

    def run_conv(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for stack, sun in batches:
            x = rows_of(stack, channels, depth)
            yield finish(predict(net, shipped.value, x, rows_of(sun, width)))

    def run_flat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vector in batches:
            yield finish(predict(net, shipped.value, None, rows_of(vector, width)))

    # Annotations are strings in this module; the UDF needs the types themselves.
    run_conv.__annotations__ = {
        "batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]
    }
    run_flat.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    if convolutional:
        sun = F.slice(scalars, 1, width)
        return df.withColumn(column, F.arrow_udf(run_conv, "double")(snow, sun))
    return df.withColumn(column, F.arrow_udf(run_flat, "double")(scalars))


def _spread(column: pa.Array, mean: float, std: float, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled values by row and layer, which entries are present, and each row's plain sum.

    The buffers of the lists are read as they are: values and lengths.
    """
    values = column.flatten()
    present = values.is_valid().to_numpy(zero_copy_only=False)
    plain = values.to_numpy(zero_copy_only=False).astype("float64", copy=False)
    sizes = column.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    layer = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(layer) and layer.max() >= depth:
        if (present & (layer >= depth)).any():
            raise ValueError(f"a profile has a layer beyond depth {depth}")
        kept = layer < depth
        row, layer, plain, present = row[kept], layer[kept], plain[kept], present[kept]
    shape = (len(sizes), depth)
    scaled = np.zeros(shape) if std else np.full(shape, np.nan)
    if std:
        scaled[row, layer] = np.where(present, (plain - mean) / std, 0.0)
    there = np.zeros(shape)
    there[row, layer] = present
    return scaled, there, np.bincount(row, np.where(present, plain, 0.0), len(sizes))


def score_profiles(
    df: DataFrame,
    norm: Norm,
    net: Net,
    parameters: list[tuple[np.ndarray, np.ndarray]],
    layers: int,
    column: str = "yhat",
    dtype: str = "float32",
) -> DataFrame:
    """Score samples straight from their stored arrays.

    What :func:`build_features` and :func:`score` do in two steps, without a
    padded vector in the JVM: the lists' values and lengths go to the worker,
    which scales them and puts each at its row and layer.  A layer beyond the
    depth is an error, a missing sun input a missing prediction.
    """
    check_parameters(net, layers, parameters)
    shipped = df.sparkSession.sparkContext.broadcast(
        [(w.astype(dtype), b.astype(dtype)) for w, b in parameters]
    )
    convolutional = bool(net.stages)
    mean, std, scalars = norm.mean, norm.std, net.scalars

    def numbers(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False).astype("float64", copy=False)

    def sun_of(variable: str, column: pa.Array) -> np.ndarray:
        if not std[variable]:
            return np.full(len(column), np.nan)
        scaled = (numbers(column) - mean[variable]) / std[variable]
        missing = column.is_null().to_numpy(zero_copy_only=False)
        return scaled if convolutional else np.where(missing, 0.0, scaled)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_spread(c, mean[v], std[v], layers) for v, c in zip(LAYER_VARS, batch)]
            stack = np.stack([parts[0][1], *[p[0] for p in parts]], axis=1).astype(dtype)
            direct, diffuse, angle = batch[len(LAYER_VARS) :]
            sun = [sun_of("direct_sw", direct), sun_of("diffuse_sw", diffuse)]
            if convolutional:
                inputs = [*sun, numbers(angle), np.minimum(MAX_DEPTH, parts[0][2])][:scalars]
                x, rest = stack, np.stack(inputs, axis=1)
            else:
                x, rest = None, np.stack([*sun, sun_of("cos_sza", angle)], axis=1)
                rest = np.concatenate([stack.reshape(len(stack), -1), rest], axis=1)
            values = predict(net, shipped.value, x, rest.astype(dtype))
            yield pa.array(values.astype("float64"), mask=np.isnan(values))

    # Annotations are strings in this module; the UDF needs the types themselves.
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return df.withColumn(column, F.arrow_udf(run, "double")(*LAYER_VARS, *SUN_VARS))
