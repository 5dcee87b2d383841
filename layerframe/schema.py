"""Names, units and schemas of the layered-profile tables.

A *sample* is one grid point at one hour.  Its scalar measurements are plain
columns; its stacked layers are one ``array<double>`` per variable, index 0
being the surface.  Arrays keep the row narrow (whole-stage code generation is
switched off above ``spark.sql.codegen.maxFields`` columns); the published wide
layout with one column per layer is produced only at the boundary by
:func:`layerframe.operators.features.to_wide`.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Variable names, units and ranges of the published dataset.
DEFAULT_LAYERS = 50
PRESENCE = "snow_layer"
LAYER_VARS = ["dz", "ssa", "density", "conc_soot", "conc_dust"]
SUN_VARS = ["direct_sw", "diffuse_sw", "cos_sza"]
TARGET = "albedo"
STAT_VARS = LAYER_VARS + SUN_VARS + [TARGET]
ID_VARS = ["time", "ZS", "aspect", "slope", "massif_number"]
SEASON_START_MONTH = 8

ID_LABELS = {
    "time": "time",
    "ZS": "altitude",
    "aspect": "slope aspect",
    "slope": "slope angle",
    "massif_number": "massif number",
}
VARIABLE_LABELS = {
    "snow_layer": "snow layer existence (bool)",
    "dz": "snow layer thickness (m)",
    "ssa": "snow layer specific surface area (m2 kg-1)",
    "density": "snow density (kg/m3)",
    "conc_soot": "concentration of soot (g/g)",
    "conc_dust": "concentration of dust (g/g)",
    "direct_sw": "surface incident direct shortwave radiation (W/m2)",
    "diffuse_sw": "surface incident diffuse shortwave radiation (W/m2)",
    "cos_sza": "cosinus of the solar zenith angle",
    "albedo": "snow albedo",
}

# Columns every stored sample table is partitioned by.
UNIT_COLS = ["geo", "season", "month"]
GROUP_COLS = ["geo", "season"]

# Scalars materialised next to the arrays: a predicate on an array element is
# never pushed to Parquet, a predicate on these is.
SURFACE_COLS = ["surface_ssa", "surface_density", "surface_dust"]


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


POINT_SCHEMA = T.StructType([
    _field("point_id", T.LongType()),
    _field("geo", T.StringType()),
    _field("massif_number", T.IntegerType()),
    _field("zs", T.DoubleType()),
    _field("aspect", T.DoubleType()),
    _field("slope", T.DoubleType()),
    _field("lat", T.DoubleType()),
    _field("lon", T.DoubleType()),
])

FORCING_SCHEMA = T.StructType([
    _field("time", T.TimestampNTZType()),
    _field("point_id", T.LongType()),
    _field("direct_sw", T.DoubleType()),
    _field("diffuse_sw", T.DoubleType()),
    _field("imp_dry1", T.DoubleType()),
    _field("imp_wet1", T.DoubleType()),
    _field("imp_dry2", T.DoubleType()),
    _field("imp_wet2", T.DoubleType()),
    _field("geo", T.StringType()),
    _field("season", T.StringType()),
])

PROFILE_SCHEMA = T.StructType([
    _field("time", T.TimestampNTZType()),
    _field("point_id", T.LongType()),
    _field("patch", T.IntegerType()),
    _field("swe", T.DoubleType()),
    _field("albedo", T.DoubleType()),
    *[_field(v, T.ArrayType(T.DoubleType())) for v in LAYER_VARS],
    _field("geo", T.StringType()),
    _field("season", T.StringType()),
])

SAMPLE_SCHEMA = T.StructType([
    _field("time", T.TimestampNTZType()),
    _field("point_id", T.LongType()),
    _field("zs", T.DoubleType()),
    _field("aspect", T.DoubleType()),
    _field("slope", T.DoubleType()),
    _field("massif_number", T.IntegerType()),
    *[_field(v, T.ArrayType(T.DoubleType())) for v in LAYER_VARS],
    *[_field(v, T.DoubleType()) for v in SUN_VARS],
    _field(TARGET, T.DoubleType()),
    *[_field(c, T.DoubleType()) for c in SURFACE_COLS],
    _field("thickness", T.DoubleType()),
    _field("n_layers", T.IntegerType()),
    _field("geo", T.StringType()),
    _field("season", T.StringType()),
    _field("month", T.IntegerType()),
])

# The three header shapes training logs come in.
LOG_CURRENT = T.StructType([
    _field("epoch", T.LongType()),
    _field("learning_rate", T.DoubleType()),
    _field("train_loss", T.DoubleType()),
    _field("train_metric", T.DoubleType()),
    _field("test_loss", T.DoubleType()),
    _field("test_metric", T.DoubleType()),
])
LOG_FOUR_METRICS = T.StructType([f for f in LOG_CURRENT if f.name != "learning_rate"])
LOG_SHORT = T.StructType([
    _field("epoch", T.LongType()),
    _field("loss", T.DoubleType()),
    _field("metric", T.DoubleType()),
])
LOG_SHAPES = {"current": LOG_CURRENT, "four_metrics": LOG_FOUR_METRICS, "short": LOG_SHORT}


def wide_columns(layers: int = DEFAULT_LAYERS) -> list[str]:
    """Column order of the published wide table (309 columns for 50 layers)."""
    per_layer = [f"{v}{i}" for v in [PRESENCE, *LAYER_VARS] for i in range(1, layers + 1)]
    return [*ID_VARS, *per_layer, *SUN_VARS, TARGET]
