"""Layer functions, scalar functions, scoring and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerframe.functions import layers as I
from layerframe.functions import maths as J_maths
from layerframe.functions import names as J_names
from layerframe.functions import sql as sql_functions
from layerframe.functions import times as J_times
from layerframe.functions.sun import cos_sza
from layerframe.operators import features as I_features
from layerframe.operators import learning as K_learning
from layerframe.operators import nets
from layerframe.operators import scoring as K_scoring
from layerframe.operators.metrics import best_trial, evaluate
from layerframe.operators.joins import assign_split
from layerframe.operators.profiles import layer_scale
from layerframe.plans.evaluation import fit_norm, report, report_models, score_samples
from layerframe.schema import LAYER_VARS

from . import views
from .registry import query
from .section_ab import FEATURE_SUM, train_norm, weighted_sum
from .section_efgh import _BOXES
from .sql import L, big, cos_sza as cos_sza_sql, rd, sql, ts

_POSITIONS = f"(SELECT unnest(generate_series(1, {L})) AS i)"
_LAYER_VALUES = ", ".join(f"{v}[i] AS {v}" for v in LAYER_VARS)


def _padded(spark, sf):
    """Samples with every profile padded to the published depth."""
    return views.samples(spark, sf).withColumns({v: I.pad_layers(v, L) for v in LAYER_VARS})


def _opened(df, *arrays):
    """One row per sample and layer position, counted from 1."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    rows = df.select("sample_id", F.posexplode(zipped).alias("i", "_at"))
    return rows.select("sample_id", (F.col("i") + 1).alias("i"), "_at.*")


# --- layers and features ---

# What is left of a long above these is exact as a double.
_LOW_BITS = 30


@query("i1_to_wide", sql(
    f"SELECT {big('sample_id')} AS sample_id, "
    + ", ".join(f"{rd(f'{v}[{i}]')} AS {v}{i}" for v in LAYER_VARS for i in range(1, L + 1))
    + " FROM fx_sample"))
def _(spark, sf):
    table = views.samples(spark, sf)
    # The published layout has no other id: ``ZS`` carries the key's upper bits and ``massif_number`` the lower ones.
    keyed = table.withColumns({
        "zs": F.shiftright("sample_id", _LOW_BITS).cast("double"),
        "massif_number": F.col("sample_id").bitwiseAND((1 << _LOW_BITS) - 1).cast("int"),
    })
    wide = I_features.to_wide(keyed, L)
    key = F.shiftleft(F.col("ZS").cast("long"), _LOW_BITS).bitwiseOR(F.col("massif_number").cast("long"))
    return wide.select(key.alias("sample_id"),
                       *[f"{v}{i}" for v in LAYER_VARS for i in range(1, L + 1)])


@query("i2_from_wide", sql(f"""
SELECT {ts('time')} AS time, {rd('zs')} AS zs, {rd('thickness')} AS thickness, {rd('albedo', 9)} AS albedo,
  {big('n_layers')} AS n_layers, {rd('surface_ssa')} AS surface_ssa FROM fx_sample"""), digits=9)
def _(spark, sf):
    back = I_features.from_wide(I_features.to_wide(views.samples(spark, sf), L), L)
    return back.select(
        "time", "zs", F.round(I.thickness("dz"), 6).alias("thickness"), "albedo",
        I.layer_count("dz").alias("n_layers"), I.surface("ssa").alias("surface_ssa"),
    )


@query("i3_layer_presence", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big('i')} AS i, CAST(dz[i] IS NOT NULL AS BIGINT) AS present
FROM fx_sample, {_POSITIONS}"""))
def _(spark, sf):
    flagged = _padded(spark, sf).withColumn("present", I.layer_presence("dz"))
    return _opened(flagged, "present")


@query("i4_pad_layers", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big('i')} AS i, {rd('dz[i]')} AS dz FROM fx_sample, {_POSITIONS}"""))
def _(spark, sf):
    short = views.samples(spark, sf).withColumn("dz", F.array_compact("dz"))
    return _opened(short.withColumn("dz", I.pad_layers("dz", L)), "dz")


@query("i5_thickness", sql(f"SELECT {big('sample_id')} AS sample_id, {rd('thickness')} AS thickness FROM fx_sample"))
def _(spark, sf):
    table = views.samples(spark, sf)
    return table.select("sample_id", I.thickness("dz").alias("thickness"))


@query("i5_sql_thickness", sql(f"SELECT {big('sample_id')} AS sample_id, {rd('thickness')} AS thickness, {big('n_layers')} AS n_layers FROM fx_sample"))
def _(spark, sf):
    sql_functions.register(spark)
    return spark.sql(
        "SELECT sample_id, thickness(dz) AS thickness, layer_count(dz) AS n_layers FROM {rows}", rows=views.samples(spark, sf)
    )


@query("i6_impute", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big('i')} AS i, {rd('coalesce(density[i], density_mean)')} AS density
FROM fx_sample, fx_norm, {_POSITIONS}"""))
def _(spark, sf):
    mean = train_norm(spark, sf).mean["density"]
    filled = _padded(spark, sf).withColumn("density", I.impute("density", mean))
    return _opened(filled, "density")


@query("i7_normalize_layers", sql(
    f"SELECT {big('sample_id')} AS sample_id, {big('i')} AS i, {rd('(dz[i] IS NOT NULL)::INTEGER')} AS snow_layer, "
    + ", ".join(f"{rd(f'coalesce(({v}[i] - {v}_mean) / {v}_std, 0)')} AS {v}" for v in LAYER_VARS)
    + f" FROM fx_sample, fx_norm, {_POSITIONS}"))
def _(spark, sf):
    scaled = I_features.normalize_layers(views.samples(spark, sf), train_norm(spark, sf))
    return _opened(scaled, "snow_layer", *LAYER_VARS)


@query("i8_normalize_sun", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('(direct_sw - direct_sw_mean) / direct_sw_std')} AS direct_sw,
  {rd('(diffuse_sw - diffuse_sw_mean) / diffuse_sw_std')} AS diffuse_sw, {rd('cos_sza')} AS cos_sza
FROM fx_sample, fx_norm"""))
def _(spark, sf):
    scaled = I_features.normalize_sun(views.samples(spark, sf), train_norm(spark, sf))
    return scaled.select("sample_id", "direct_sw", "diffuse_sw", "cos_sza")


_SUN_TERMS = " + ".join(
    f"{6 * L + k} * coalesce(({v} - {v}_mean) / {v}_std, 0)"
    for k, v in enumerate(("direct_sw", "diffuse_sw", "cos_sza"), start=1)
)


def _flat_sum(parts: str) -> str:
    return f"""
fx_flat AS (
  SELECT *, list_sum([x.i * coalesce(x.v, 0) FOR x IN
      list_transform(generate_series(1, {6 * L}), lambda k: {{'i': k, 'v': flat[k]}})]) AS layer_sum
  FROM (SELECT s.*, fx_norm.*, list_concat(
      list_transform(dz, lambda x: CASE WHEN x IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END),
      {parts}) AS flat FROM fx_sample s, fx_norm))"""


@query("i9_normalize_flat", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big(6 * L + 3)} AS width, {rd(f'layer_sum + {_SUN_TERMS}', 5)} AS flat_sum
FROM fx_flat""", _flat_sum(", ".join(
    f"list_transform({v}, lambda x: (x - {v}_mean) / {v}_std)" for v in LAYER_VARS))), digits=5)
def _(spark, sf):
    vector = I_features.normalize_flat(fit_norm(views.samples(spark, sf), views.plan(spark, sf)))
    flat = views.samples(spark, sf).select("sample_id", vector.alias("x"))
    return flat.select("sample_id", F.size("x").alias("width"), weighted_sum("x").alias("flat_sum"))


@query("i10_target_scaling", sql(f"""
SELECT geo, season, {rd('avg((albedo - albedo_mean) / albedo_std)')} AS mean_scaled,
  {rd('max(albedo)', 6)} AS max_restored, {rd('avg((albedo - yhat) * (albedo - yhat))')} AS mse_restored
FROM fx_pred, fx_norm GROUP BY geo, season"""))
def _(spark, sf):
    norm = train_norm(spark, sf)
    scaled = I_features.normalize_target(views.predictions(spark, sf), norm)
    scaled = I_features.normalize_target(scaled, norm, "yhat").withColumn("scaled", F.col("albedo"))
    error = F.col("scaled") - F.col("yhat")
    restored = I_features.denormalize_target(scaled, norm)
    return restored.groupBy("geo", "season").agg(
        F.avg("scaled").alias("mean_scaled"),
        F.max("albedo").alias("max_restored"),
        I_features.denormalize_mse(F.avg(error * error), norm).alias("mse_restored"),
    )


@query("i11_sun_vector", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big('i')} AS i,
  {rd('[direct_sw, diffuse_sw, cos_sza, thickness][i]')} AS x
FROM fx_sample, (SELECT unnest([1, 2, 3, 4]) AS i)"""))
def _(spark, sf):
    table = views.samples(spark, sf)
    return _opened(table.select("sample_id", I_features.sun_vector().alias("x")), "x")


@query("i12_reshape", f"""
SELECT {big('vec_id')} AS vec_id, {big('r')} AS r, {big('c')} AS c, {rd('embedding[r * 16 + c + 1]')} AS x
FROM embeddings, (SELECT unnest(generate_series(0, 3)) AS r), (SELECT unnest(generate_series(0, 15)) AS c)""")
def _(spark, sf):
    matrix = views.table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(I.reshape("embedding", 4, 16)).alias("r", "_row")
    )
    return matrix.select("vec_id", "r", F.posexplode("_row").alias("c", "x"))


@query("i12_snow_matrix", sql(
    f"SELECT {big('sample_id')} AS sample_id, {big('i')} AS i, {rd('(dz[i] IS NOT NULL)::INTEGER')} AS row1, "
    + ", ".join(f"{rd(f'{v}[i]')} AS row{r}" for r, v in enumerate(LAYER_VARS, start=2))
    + f" FROM fx_sample, {_POSITIONS}"))
def _(spark, sf):
    stacked = _padded(spark, sf).withColumn("snow_layer", I_features.presence_values(L))
    matrix = stacked.select("sample_id", I_features.snow_matrix().alias("m"))
    split = matrix.select("sample_id", *[F.get("m", F.lit(r)).alias(f"row{r + 1}") for r in range(6)])
    return _opened(split, *[f"row{r}" for r in range(1, 7)])


@query("i13_flat_vector", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big(6 * L + 3)} AS width,
  {rd(f'layer_sum + {6 * L + 1} * direct_sw + {6 * L + 2} * diffuse_sw + {6 * L + 3} * cos_sza', 4)} AS flat_sum
FROM fx_flat""", _flat_sum(", ".join(LAYER_VARS))), digits=4)
def _(spark, sf):
    flat = views.samples(spark, sf).select("sample_id", I_features.flat_vector().alias("x"))
    filled = F.transform("x", lambda x: F.coalesce(x, F.lit(0.0)))
    return flat.select("sample_id", F.size("x").alias("width"), weighted_sum(filled).alias("flat_sum"))


@query("i14_float32", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big('i')} AS i, {rd('CAST(ssa[i] AS FLOAT)')} AS ssa
FROM fx_sample, {_POSITIONS}"""))
def _(spark, sf):
    return _opened(_padded(spark, sf).withColumn("ssa", I.to_float32("ssa")), "ssa")


@query("i15_ground_first", sql(f"""
SELECT {big('sample_id')} AS sample_id,
  row_number() OVER (PARTITION BY sample_id ORDER BY layer DESC) AS i, {rd('ssa')} AS ssa FROM fx_layer"""))
def _(spark, sf):
    table = views.samples(spark, sf)
    return _opened(table.select("sample_id", I.ground_first("ssa", "dz").alias("ssa")), "ssa")


@query("i16_layer_scale", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big('level')} AS level, {rd('shade')} AS shade FROM fx_shade""", _BOXES))
def _(spark, sf):
    return layer_scale(views.samples(spark, sf), "ssa")


_SUN_FEATURES = {
    "sun1": "(direct_sw - direct_sw_mean) / direct_sw_std",
    "sun2": "(diffuse_sw - diffuse_sw_mean) / diffuse_sw_std",
    "sun3": "cos_sza",
    "sun4": "thickness",
}


@query("i17_build_features", sql(
    f"SELECT {big('sample_id')} AS sample_id, {rd('snow_sum', 4)} AS snow_sum, "
    + ", ".join(f"{rd(f'CAST({e} AS FLOAT)', 4)} AS {n}" for n, e in _SUN_FEATURES.items())
    + f", {rd('CAST(albedo AS FLOAT)', 4)} AS y FROM fx_feature, fx_norm", FEATURE_SUM), digits=4)
def _(spark, sf):
    features = I_features.build_features(
        views.samples(spark, sf), train_norm(spark, sf), ("sample_id",), L
    )
    return features.select(
        "sample_id", weighted_sum(F.flatten("x_snow")).alias("snow_sum"),
        *[F.get("x_sun", F.lit(k)).alias(f"sun{k + 1}") for k in range(4)], "y",
    )


# --- scalar functions ---

@query("j1_names", sql("""
SELECT geo, season, geo || '_' || season || '_' || month AS unit,
  'PRO_' || replace(season, '_', '080106_') || '080106.nc' AS profile, season AS parsed,
  CAST(length(season) = 9 AS BIGINT) AS named, CAST(contains(season, '1999') AS BIGINT) AS has_1999 FROM fx_unit"""))
def _(spark, sf):
    units = views.units(spark, sf)
    years = F.split("season", "_")
    name = F.concat(F.lit("FORCING_"), years[0], F.lit("080106_"), years[1], F.lit("080106.nc"))
    return units.select(
        "geo", "season", J_names.unit_name("geo", "season", "month").alias("unit"),
        J_names.profile_name(name).alias("profile"), J_names.season_of_forcing(name).alias("parsed"),
        J_names.is_season("season").alias("named"), F.col("season").contains("1999").alias("has_1999"),
    )


@query("j2_dates", f"""
SELECT {big('event_id')} AS event_id, {big('month(ts)')} AS month,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000' AS iso, strftime(ts, '%Y-%m') AS year_month,
  strftime(ts, '%m-%d') AS month_day, {ts("date_trunc('month', ts)")} AS month_start,
  {ts("date_trunc('hour', ts)")} AS hour_start, {big('epoch_us(ts)')} AS micros,
  CAST(year(ts) - CASE WHEN month(ts) < 8 THEN 1 ELSE 0 END AS VARCHAR) || '_' ||
    CAST(year(ts) + CASE WHEN month(ts) < 8 THEN 0 ELSE 1 END AS VARCHAR) AS season,
  {ts('ts + INTERVAL 1 HOUR')} AS next_hour,
  CAST(TIMESTAMP '2024-01-15' > ts + INTERVAL 1 DAY AS BIGINT) AS long_before
FROM events""")
def _(spark, sf):
    iso = J_times.iso_string("ts")
    return views.table(spark, sf, "events").select(
        "event_id", F.month("ts").alias("month"), iso.alias("iso"),
        J_times.year_month("ts").alias("year_month"), J_times.month_day("ts").alias("month_day"),
        J_times.month_start(J_times.parse_iso(iso)).alias("month_start"),
        J_times.hour_start("ts").alias("hour_start"), J_times.micros("ts").alias("micros"),
        J_times.season_name(J_times.season_start_year("ts")).alias("season"),
        (F.col("ts") + J_times.interval(J_times.HOUR)).alias("next_hour"),
        J_times.exceeds_step("ts", J_times.ntz("2024-01-15"), J_times.DAY).alias("long_before"),
    )


@query("j3_maths", f"""
SELECT {big('o_orderkey')} AS o_orderkey, {rd('sqrt(o_totalprice)', 7)} AS root,
  {rd('pow(o_totalprice / 100000, 2)', 7)} AS square, {big('floor(o_totalprice / 3)')} AS down,
  {big('ceil(o_totalprice / 3)')} AS up, {rd('least(o_totalprice, 1000)', 7)} AS smallest,
  {rd('1 / (1 + exp(-(o_totalprice / 100000 - 2)))', 7)} AS sigmoid,
  {rd('greatest(0, o_totalprice / 100000 - 2)', 7)} AS relu,
  {rd('CASE WHEN o_totalprice > 200000 THEN o_totalprice / 100000 - 2 ELSE exp(o_totalprice / 100000 - 2) - 1 END', 7)} AS elu,
  {rd('abs(o_totalprice - 200000)', 7)} AS distance FROM orders""", digits=7)
def _(spark, sf):
    price = F.col("o_totalprice")
    z = price / 100000 - 2
    return views.table(spark, sf, "orders").select(
        "o_orderkey", F.sqrt(price).alias("root"), F.pow(price / 100000, 2).alias("square"),
        F.floor(price / 3).alias("down"), F.ceil(price / 3).alias("up"),
        F.least(price, F.lit(1000.0)).alias("smallest"), J_maths.sigmoid(z).alias("sigmoid"),
        J_maths.relu(z).alias("relu"), J_maths.elu(z).alias("elu"),
        F.abs(price - 200000).alias("distance"),
    )


@query("j4_cos_sza", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd(cos_sza_sql('time', 'lat', 'lon'))} AS horizontal,
  {rd(cos_sza_sql('time', 'lat', 'lon', 'slope', 'aspect'))} AS tilted,
  {rd(cos_sza_sql('(time + INTERVAL 12 HOUR)', 'lat', 'lon'))} AS noon FROM fx_at"""))
def _(spark, sf):
    noon = "(time + INTERVAL 12 HOURS)"
    return views.forcing_at_points(spark, sf).select(
        "sample_id", cos_sza("time", "lat", "lon").alias("horizontal"),
        cos_sza("time", "lat", "lon", "slope", "aspect").alias("tilted"),
        cos_sza(noon, "lat", "lon").alias("noon"),
    )


# --- scoring, evaluation, learning ---

_WEIGHTS = [0.4, -0.3, 0.2, 0.9]


@query("k1_score_dense", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('''1 / (1 + exp(-(CAST(0.1 AS DOUBLE) + 0.4 * (direct_sw - direct_sw_mean) / direct_sw_std
  - 0.3 * (diffuse_sw - diffuse_sw_mean) / diffuse_sw_std + 0.2 * cos_sza + 0.9 * thickness)))''')} AS yhat
FROM fx_sample, fx_norm"""))
def _(spark, sf):
    scaled = I_features.normalize_sun(views.samples(spark, sf), train_norm(spark, sf))
    vector = scaled.select("sample_id", I_features.sun_vector().alias("x"))
    return K_scoring.score_dense(vector, "x", _WEIGHTS, 0.1).select("sample_id", "yhat")


# The published stacks with narrow layers, so that SQL can follow the arithmetic.
_CONVS = nets.convs(True, (2, 1), (2, 1), (2, 1), (2, 2), (2, 2), (2, 2))
NARROW_NET = nets.Net(_CONVS, (4, 4, 3, 2), "elu")
_NARROW = {
    "k1_score_narrow_net": NARROW_NET,
    "k1_score_narrow_linear_net": nets.Net(_CONVS, (4, 4, 3, 2), "elu", output="linear"),
    "k1_score_narrow_max_pool_net": nets.Net(
        (*nets.convs(True, (2, 1), (2, 1), (2, 1), (3, 1), (3, 1), (3, 1)), ("global_max",)),
        (4, 4, 3, 2), "elu",
    ),
    "k1_score_narrow_initial_net": nets.Net(
        (
            *nets.convs(False, (2, 1), (2, 1)), ("pool", 2),
            *nets.convs(False, (2, 1), (3, 1), (3, 1)), ("pool", 5),
            *nets.convs(False, (3, 1), (3, 1)), ("global_max",),
        ),
        (4, 4, 4, 3, 2), "relu", scalars=3,
    ),
    "k1_score_narrow_flat_net": nets.Net((), (8, 8, 8, 6, 6, 4), "relu"),
}


def _numbers(name: str, count: int) -> str:
    return f"(SELECT unnest(generate_series(0, {count - 1})) AS {name})"


def net_steps(net: nets.Net) -> list[str]:
    """The forward pass as joins with the weight formula, one table per step.

    The last one is ``scored(sample_id, yhat)``.
    """
    shapes = iter(nets.parameter_shapes(net, L))
    scaled = " ".join(
        f"WHEN {k} THEN coalesce(({v}[p + 1] - {v}_mean) / {v}_std, 0)"
        for k, v in enumerate(LAYER_VARS, start=1)
    )
    ctes = [f"""
t0 AS (
  SELECT sample_id, c, p, CASE c WHEN 0 THEN CAST(dz[p + 1] IS NOT NULL AS INTEGER)::DOUBLE {scaled} END AS x
  FROM fx_sample, fx_norm, {_numbers('c', 6)}, {_numbers('p', L)})"""]
    length, channels, number = L, 6, 0

    def step(body: str) -> None:
        ctes.append(f"t{len(ctes)} AS ({body})")

    def weight(flat: str, inputs: int) -> str:
        return f"sin(CAST({flat} + {number + 1} AS DOUBLE)) / sqrt(CAST({inputs} AS DOUBLE))"

    def bias() -> str:
        return f"sin(CAST(o + {number + 1} AS DOUBLE)) / 10"

    def activate() -> None:
        lower = "0" if net.activation == "relu" else "exp(x) - 1"
        step(f"SELECT sample_id, c, p, CASE WHEN x > 0 THEN x ELSE {lower} END AS x FROM t{len(ctes) - 1}")

    for stage in net.stages:
        source = f"t{len(ctes) - 1}"
        if stage[0] == "conv":
            (width, inputs, kernel), stride = next(shapes)[0], stage[2]
            after = -(-length // stride)
            step(f"""
  SELECT sample_id, o AS c, q AS p, sum(x * w) + {bias()} AS x FROM {source} n JOIN (
    SELECT o, c, k, {weight(f"o * {inputs * kernel} + c * {kernel} + k", inputs * kernel)} AS w
    FROM {_numbers('o', width)}, {_numbers('c', inputs)}, {_numbers('k', kernel)}) USING (c), {_numbers('q', after)}
  WHERE n.p = q * {stride} + k - 1 GROUP BY sample_id, o, q""")
            length, channels, number = after, width, number + 1
        elif stage[0] == "act":
            activate()
        elif stage[0] == "pool":
            length //= stage[1]
            step(f"""
  SELECT sample_id, c, p // {stage[1]} AS p, max(x) AS x FROM {source} WHERE p < {length * stage[1]}
  GROUP BY sample_id, c, p // {stage[1]}""")
        else:
            step(f"SELECT sample_id, c, 0 AS p, max(x) AS x FROM {source} GROUP BY sample_id, c")
            length = 1
    rule = "cos_sza" if net.stages else "(cos_sza - cos_sza_mean) / cos_sza_std"
    sun = f"""[(direct_sw - direct_sw_mean) / direct_sw_std, (diffuse_sw - diffuse_sw_mean) / diffuse_sw_std, {rule}, thickness]"""
    scalars = net.scalars if net.stages else 3
    step(f"""
  SELECT sample_id, c * {length} + p AS c, 0 AS p, x FROM t{len(ctes) - 1} UNION ALL
  SELECT sample_id, {channels * length} + j, 0, {sun}[j + 1] FROM fx_sample, fx_norm, {_numbers('j', scalars)}""")
    for at, width in enumerate((*net.dense, 1)):
        inputs = next(shapes)[0][1]
        step(f"""
  SELECT sample_id, o AS c, 0 AS p, sum(x * {weight(f"o * {inputs} + c", inputs)}) + {bias()} AS x
  FROM t{len(ctes) - 1}, {_numbers('o', width)} GROUP BY sample_id, o""")
        number += 1
        if at < len(net.dense):
            activate()
    result = "1 / (1 + exp(-x))" if net.output == "sigmoid" else "x"
    return [*ctes, f"scored AS (SELECT sample_id, {result} AS yhat FROM t{len(ctes) - 1})"]


def _net_sql(net: nets.Net) -> str:
    return sql(f"SELECT {big('sample_id')} AS sample_id, {rd('yhat')} AS yhat FROM scored", *net_steps(net))


def _register_narrow(name: str, net: nets.Net) -> None:
    @query(name, _net_sql(net))
    def _(spark, sf):
        # Doubles all the way: the comparison is about the arithmetic, not float32.
        norm, table = train_norm(spark, sf), views.samples(spark, sf)
        weights = nets.waves(net, L, "float64")
        if not net.stages:
            inputs = table.select("sample_id", I_features.normalize_flat(norm).alias("x"))
            scored = K_scoring.score(inputs, net, weights, L, scalars="x", dtype="float64")
            return scored.select("sample_id", "yhat")
        scaled = I_features.normalize_sun(I_features.normalize_layers(table, norm), norm)
        inputs = scaled.select(
            "sample_id", I_features.snow_matrix().alias("x_snow"), I_features.sun_vector().alias("x_sun")
        )
        return K_scoring.score(inputs, net, weights, L, dtype="float64").select("sample_id", "yhat")


for _name, _net in _NARROW.items():
    _register_narrow(_name, _net)


def _register_net(name: str, net: nets.Net, depth: int) -> None:
    @query(name, digits=4)
    def _(spark, sf):
        scored = score_samples(
            views.samples(spark, sf), train_norm(spark, sf), nets.waves(net, depth), net,
            ("sample_id",), depth,
        )
        return scored.select("sample_id", "yhat")


_register_net("k1_score_conv_net", nets.CONV_NET, 50)
_register_net("k1_score_conv_net_linear", nets.CONV_NET_LINEAR, 50)
_register_net("k1_score_max_pool_net", nets.MAX_POOL_NET, 50)
_register_net("k1_score_initial_net", nets.INITIAL_NET, 50)
_register_net("k1_score_flat_net", nets.FLAT_NET, 50)


@query("k2_evaluate", sql(f"""
SELECT split, count(*) AS n, {rd('avg((albedo - yhat) * (albedo - yhat))', 9)} AS mse,
  {rd('avg(abs(albedo - yhat))', 9)} AS mae, {rd('sqrt(avg((albedo - yhat) * (albedo - yhat)))', 9)} AS rmse
FROM fx_labelled GROUP BY split"""), digits=9)
def _(spark, sf):
    return evaluate(views.labelled_predictions(spark, sf))


@query("k2_net_report", sql(f"""
SELECT split, count(*) AS n, {rd('avg(pow(albedo - s.yhat, 2))', 4)} AS mse, {rd('avg(abs(albedo - s.yhat))', 4)} AS mae,
  {rd('sqrt(avg(pow(albedo - s.yhat, 2)))', 4)} AS rmse FROM fx_labelled JOIN scored s USING (sample_id) GROUP BY split""",
*net_steps(NARROW_NET)), digits=4)
def _(spark, sf):
    weights = nets.waves(NARROW_NET, L)
    return report(views.samples(spark, sf), views.plan(spark, sf), weights, NARROW_NET, L)


def _labelled_samples(spark, sf):
    columns = ["split", "thickness", "n_layers", "direct_sw", "diffuse_sw", "cos_sza", "albedo"]
    return assign_split(views.samples(spark, sf), views.plan(spark, sf)).select(*columns)


@query("k3_linear_fit", sql(f"""
SELECT split, count(*) AS n, {rd('avg(pow(albedo - (b0 + b1 * direct_sw), 2))')} AS mse,
  {rd('avg(abs(albedo - (b0 + b1 * direct_sw)))')} AS mae,
  {rd('sqrt(avg(pow(albedo - (b0 + b1 * direct_sw), 2)))')} AS rmse
FROM fx_labelled, (SELECT regr_intercept(albedo, direct_sw) AS b0, regr_slope(albedo, direct_sw) AS b1
  FROM fx_labelled WHERE split = 'train') GROUP BY split"""))
def _(spark, sf):
    rows, features = _labelled_samples(spark, sf), ["direct_sw"]
    model = K_learning.fit_regressor(rows.where("split = 'train'"), features, solver="normal")
    return evaluate(K_learning.predict_with(model, rows, features))


# One tree of one split on the number of layers: the split that leaves the least squared error.
@query("k3_gbt_fit", sql(f"""
SELECT split, count(*) AS n, {rd('avg(pow(albedo - yhat, 2))')} AS mse, {rd('avg(abs(albedo - yhat))')} AS mae,
  {rd('sqrt(avg(pow(albedo - yhat, 2)))')} AS rmse
FROM (SELECT split, albedo, CASE WHEN n_layers <= cut THEN low ELSE high END AS yhat FROM fx_labelled, stump) GROUP BY split""",
"""
tally AS (SELECT n_layers AS v, count(*) AS n, sum(albedo) AS s FROM fx_labelled WHERE split = 'train' GROUP BY 1),
sides AS (SELECT v, sum(n) OVER (ORDER BY v) AS ln, sum(s) OVER (ORDER BY v) AS ls,
  sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM tally),
stump AS (SELECT v AS cut, ls / ln AS low, (ts - ls) / (tn - ln) AS high FROM sides WHERE ln < tn
  ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC LIMIT 1)"""))
def _(spark, sf):
    rows, features = _labelled_samples(spark, sf), ["n_layers"]
    model = K_learning.fit_regressor(
        rows.where("split = 'train'"), features, kind="gbt", maxIter=1, maxDepth=1, seed=1
    )
    return evaluate(K_learning.predict_with(model, rows, features))


# Ridge on one standardised input: the slope shrinks by 1 + regParam / std(target).
_TRIALS = f"""
trials AS (SELECT {big('trial')} AS trial, {rd('reg')} AS "regParam", {rd('avg(pow(albedo - (y0 + b * (direct_sw - x0)), 2))')} AS value
FROM (SELECT albedo, direct_sw FROM fx_labelled WHERE split = 'val'),
  (SELECT trial, reg, x0, y0, slope / (1 + reg / y_std) AS b FROM
    (SELECT regr_slope(albedo, direct_sw) AS slope, avg(direct_sw) AS x0, avg(albedo) AS y0, stddev_pop(albedo) AS y_std
     FROM fx_labelled WHERE split = 'train'),
    (SELECT unnest([0, 1, 2]) AS trial, unnest([0.0, 0.01, 0.1])::DOUBLE AS reg))
GROUP BY trial, reg)"""


@query("k4_sweep", sql("SELECT * FROM trials ORDER BY value LIMIT 1", _TRIALS))
def _(spark, sf):
    rows = _labelled_samples(spark, sf)
    return best_trial(K_learning.sweep(
        rows.where("split = 'train'"), rows.where("split = 'val'"), ["direct_sw"],
        {"regParam": [0.0, 0.01, 0.1]},
    ))


@query("k4_sweep_trials", sql(f"""
SELECT {big('trial')} AS trial, {rd('reg')} AS "regParam", {rd('avg(pow(albedo - (y0 + b * (direct_sw - x0)), 2))')} AS value
FROM (SELECT albedo, direct_sw FROM fx_labelled WHERE split = 'val'),
  (SELECT trial, reg, x0, y0, slope / (1 + reg / y_std) AS b FROM
    (SELECT regr_slope(albedo, direct_sw) AS slope, avg(direct_sw) AS x0, avg(albedo) AS y0, stddev_pop(albedo) AS y_std
     FROM fx_labelled WHERE split = 'train'),
    (SELECT unnest([0, 1, 2]) AS trial, unnest([0.0, 0.01, 0.1])::DOUBLE AS reg))
GROUP BY trial, reg"""))
def _(spark, sf):
    rows = _labelled_samples(spark, sf)
    return K_learning.sweep(
        rows.where("split = 'train'"), rows.where("split = 'val'"), ["direct_sw"],
        {"regParam": [0.0, 0.01, 0.1]},
    )


# Half the train seasons for all four settings, then all of them for the better two.
_REGS = [0.0, 0.01, 0.1, 1.0]
_HALVING = [f"""
season_order AS (SELECT geo, season, row_number() OVER (ORDER BY md5('{views.SEED}' || geo || season), geo, season) AS place,
    count(*) OVER () AS total FROM (SELECT DISTINCT geo, season FROM fx_labelled WHERE split = 'train'))""", """
rung_rows AS (SELECT rung, ceil(total / pow(2, 1 - rung)) AS n_groups, albedo, direct_sw
  FROM fx_labelled JOIN season_order USING (geo, season), (SELECT unnest([0, 1]) AS rung)
  WHERE split = 'train' AND place <= ceil(total / pow(2, 1 - rung)))""", f"""
rung_fits AS (SELECT rung, n_groups, trial, reg, x0, y0, slope / (1 + reg / y_std) AS b FROM
    (SELECT rung, n_groups, regr_slope(albedo, direct_sw) AS slope, avg(direct_sw) AS x0, avg(albedo) AS y0, stddev_pop(albedo) AS y_std
     FROM rung_rows GROUP BY ALL), (SELECT unnest([0, 1, 2, 3]) AS trial, unnest({_REGS})::DOUBLE AS reg))""", """
rung_trials AS (SELECT rung, n_groups, trial, reg, avg(pow(albedo - (y0 + b * (direct_sw - x0)), 2)) AS value
  FROM rung_fits, (SELECT albedo, direct_sw FROM fx_labelled WHERE split = 'val') GROUP BY ALL)"""]


@query("k4_halving", sql(f"""
SELECT {big('rung')} AS rung, {big('n_groups')} AS n_groups, {big('trial')} AS trial, {rd('reg')} AS "regParam", {rd('value')} AS value
FROM rung_trials WHERE rung = 0 OR trial IN (SELECT trial FROM rung_trials WHERE rung = 0 ORDER BY value, trial LIMIT 2)""", *_HALVING))
def _(spark, sf):
    columns = ["geo", "season", "split", "direct_sw", "albedo"]
    rows = assign_split(views.samples(spark, sf), views.plan(spark, sf)).select(*columns)
    return K_learning.halving(
        rows.where("split = 'train'"), rows.where("split = 'val'"), ["direct_sw"], {"regParam": _REGS}, 2, seed=views.SEED
    )


@query("k2_model_table", sql(f"""
SELECT 'narrow' AS model, split, count(*) AS n, {rd('avg(pow(albedo - yhat, 2))', 4)} AS mse, {rd('avg(abs(albedo - yhat))', 4)} AS mae,
  {rd('sqrt(avg(pow(albedo - yhat, 2)))', 4)} AS rmse
FROM (SELECT s.split, s.albedo, p.yhat FROM fx_labelled s JOIN scored p USING (sample_id)) GROUP BY split
UNION ALL
SELECT 'logit', split, count(*), {rd('avg(pow(albedo - logit, 2))', 4)}, {rd('avg(abs(albedo - logit))', 4)}, {rd('sqrt(avg(pow(albedo - logit, 2)))', 4)}
FROM (SELECT s.split, s.albedo, ln(p.yhat / (1 - p.yhat)) AS logit FROM fx_labelled s JOIN scored p USING (sample_id)) GROUP BY split""",
*net_steps(NARROW_NET)), digits=4)
def _(spark, sf):
    """Two stored models over the same rows: with the sigmoid at the end, and without."""
    linear = _NARROW["k1_score_narrow_linear_net"]
    weights = nets.waves(NARROW_NET, L)
    models = {"narrow": (NARROW_NET, weights), "logit": (linear, weights)}
    return report_models(views.samples(spark, sf), views.plan(spark, sf), train_norm(spark, sf), models, L)
