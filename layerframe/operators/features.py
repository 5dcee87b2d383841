"""Layer layouts and normalised feature vectors.

Features are ordinary column expressions over the layer arrays: no Python
worker is involved and the scan stays pruned to the variables in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.layers import filled_to, pad_layers, ragged, thickness, to_float32, zscore
from ..functions.times import parse_iso
from ..schema import DEFAULT_LAYERS, LAYER_VARS, PRESENCE, SUN_VARS, TARGET, wide_columns
from .filters import id_columns
from .stats import Norm


def to_wide(df: DataFrame, layers: int = DEFAULT_LAYERS) -> DataFrame:
    """The published layout: one column per variable and layer, fixed order.

    A profile deeper than the layout is an error.
    """
    deepest = F.greatest(*[F.coalesce(F.size(ragged(v)), F.lit(0)) for v in LAYER_VARS])
    beyond = F.raise_error(F.lit(f"a profile has a layer beyond depth {layers}")).cast("boolean")
    df = df.where(F.when(deepest <= layers, F.lit(True)).otherwise(beyond))
    presence = [
        F.get("dz", F.lit(i)).isNotNull().alias(f"{PRESENCE}{i + 1}") for i in range(layers)
    ]
    values = [
        F.get(v, F.lit(i)).alias(f"{v}{i + 1}") for v in LAYER_VARS for i in range(layers)
    ]
    scalars = [F.col(c) for c in [*SUN_VARS, TARGET]]
    wide = df.select(*id_columns(df), *presence, *values, *scalars)
    return wide.select(*wide_columns(layers))


def from_wide(df: DataFrame, layers: int = DEFAULT_LAYERS) -> DataFrame:
    """Back from the published layout to arrays."""
    arrays = [F.array(*[f"{v}{i + 1}" for i in range(layers)]).alias(v) for v in LAYER_VARS]
    return df.select(
        parse_iso("time").alias("time"),
        F.col("ZS").alias("zs"),
        "aspect",
        "slope",
        "massif_number",
        *arrays,
        *SUN_VARS,
        TARGET,
    )


def collect_layers(layer_rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Long layer rows (numbered from 1) to one array per variable, as long as the profile is deep.

    A layer stands at its number, so a missing number leaves a gap.  A number
    below 1 and one that occurs twice are errors.  Each key's rows are gathered
    over a window: rows sorted by the key already, as numbered layers are, stay
    in that order for the join that follows, and none is buffered by a second
    or third sort as in an aggregation of lists.
    """
    entry = F.struct("layer", *LAYER_VARS)
    group = W.partitionBy(key)
    opened = layer_rows.select(
        key, "layer", F.min("layer").over(group).alias("_top"), F.collect_list(entry).over(group).alias("_entries")
    )
    packed = opened.where(F.col("layer").eqNullSafe(F.col("_top"))).select(key, F.sort_array("_entries").alias("stack"))
    count = F.size("stack")
    first, last = F.get("stack", F.lit(0))["layer"], F.get("stack", count - 1)["layer"]
    wrong = (first < 1) | (F.size(F.array_distinct("stack.layer")) < count)
    refused = F.raise_error(F.lit("layer numbers must be distinct and start from 1")).cast("boolean")
    checked = packed.where(F.when(F.coalesce(wrong, F.lit(True)), refused).otherwise(F.lit(True)))

    def placed(variable: str) -> Column:
        at = lambda i: F.get(F.filter("stack", lambda s: s["layer"] == i), F.lit(0))[variable]
        return F.when(last == count, F.col(f"stack.{variable}")).otherwise(
            F.transform(F.sequence(F.lit(1).cast(layer_rows.schema["layer"].dataType), last), at)
        )

    return checked.select(key, *[placed(v).alias(v) for v in LAYER_VARS])


def presence_values(layers: int = DEFAULT_LAYERS) -> Column:
    """1 where the profile has a layer, else 0, up to the depth."""
    return filled_to("dz", F.transform("dz", lambda x: x.isNotNull().cast("double")), layers, 0.0)


def scaled_layers(variable: str, norm: Norm, layers: int = DEFAULT_LAYERS) -> Column:
    """Standardise, then give absent layers the value the mean maps to: zero."""
    scaled = zscore(variable, norm.mean[variable], norm.std[variable])
    if not norm.std[variable]:
        return filled_to(variable, scaled, layers, None)
    return filled_to(variable, F.transform(scaled, lambda x: F.coalesce(x, F.lit(0.0))), layers, 0.0)


def normalize_layers(df: DataFrame, norm: Norm, layers: int = DEFAULT_LAYERS) -> DataFrame:
    """Z-scores of the five layer variables; the presence mask is added untouched."""
    return df.withColumns({
        PRESENCE: presence_values(layers),
        **{v: scaled_layers(v, norm, layers) for v in LAYER_VARS},
    })


def normalize_sun(df: DataFrame, norm: Norm) -> DataFrame:
    """Convolutional rule: both radiations are scaled, the sun angle is not."""
    return df.withColumns({
        v: norm.scale(v, F.col(v)) for v in ("direct_sw", "diffuse_sw")
    })


def normalize_target(df: DataFrame, norm: Norm, column: str = TARGET) -> DataFrame:
    return df.withColumn(column, norm.scale(TARGET, F.col(column)))


def denormalize_target(df: DataFrame, norm: Norm, column: str = TARGET) -> DataFrame:
    return df.withColumn(
        column, F.col(column) * F.lit(norm.std[TARGET]) + F.lit(norm.mean[TARGET])
    )


def denormalize_mse(mse: Column, norm: Norm) -> Column:
    """A squared error on the scaled target, back in squared target units."""
    return mse * F.lit(norm.std[TARGET] ** 2)


def sun_vector() -> Column:
    """Three sun inputs followed by the snow depth."""
    return F.array(*SUN_VARS, "thickness")


def snow_matrix() -> Column:
    """Six rows (presence first), one value per layer: variable-major order."""
    return F.array(PRESENCE, *LAYER_VARS)


def flat_vector(layers: int = DEFAULT_LAYERS) -> Column:
    """Presence, the five layer variables and the sun inputs in one vector."""
    return F.concat(presence_values(layers), *[pad_layers(v, layers) for v in LAYER_VARS], F.array(*SUN_VARS))


def normalize_flat(norm: Norm, layers: int = DEFAULT_LAYERS) -> Column:
    """Flat-network rule: every input is imputed and scaled, the sun angle too."""
    return F.concat(
        presence_values(layers), *[scaled_layers(v, norm, layers) for v in LAYER_VARS], F.array(*_flat_sun(norm))
    )


def _flat_sun(norm: Norm) -> list[Column]:
    return [
        F.coalesce(norm.scale(v, F.col(v)), F.lit(0.0)) if norm.std[v] else norm.scale(v, F.col(v))
        for v in SUN_VARS
    ]


def build_features(
    df: DataFrame, norm: Norm, keys: tuple[str, ...] = (), layers: int = DEFAULT_LAYERS
) -> DataFrame:
    """Network inputs ``x_snow`` (6 x layers), ``x_sun`` (4) and target ``y`` as float32.

    Profiles are padded here and nowhere before.  A layer beyond the depth is an
    error, so the depth covers every layer.
    """
    snow = [presence_values(layers), *[scaled_layers(v, norm, layers) for v in LAYER_VARS]]
    sun = [norm.scale("direct_sw", F.col("direct_sw")), norm.scale("diffuse_sw", F.col("diffuse_sw"))]
    return df.select(
        *keys,
        F.array(*[row.cast("array<float>") for row in snow]).alias("x_snow"),
        to_float32(F.array(*sun, F.col("cos_sza"), thickness("dz"))).alias("x_sun"),
        F.col(TARGET).cast("float").alias("y"),
    )


def build_flat_features(
    df: DataFrame, norm: Norm, keys: tuple[str, ...] = (), layers: int = DEFAULT_LAYERS
) -> DataFrame:
    """Flat-network input ``x`` (6 x layers + 3) and target ``y`` as float32."""
    return df.select(
        *keys, to_float32(normalize_flat(norm, layers)).alias("x"), F.col(TARGET).cast("float").alias("y")
    )
