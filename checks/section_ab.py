"""Sources, sinks, filters and projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from layerframe.operators import filters as B
from layerframe.operators.features import to_wide
from layerframe.operators.stats import Norm, fit_stats
from layerframe.operators.sets import union_all
from layerframe.schema import LOG_FOUR_METRICS, LOG_SHORT
from layerframe.session import scratch_path
from layerframe.sources import inputs as A_inputs
from layerframe.sources import logs as A_logs
from layerframe.plans.evaluation import fit_stored_norm
from layerframe.sources import ledger as A_ledger
from layerframe.sources import samples as A_samples
from layerframe.sources import stores as A_stores

from . import stored, views
from .registry import placed, query
from .sql import L, big, rd, sql, ts


# --- sources and sinks ---

@query("a1_read_inputs", sql(f"""
SELECT 'forcing' AS side, {big('sample_id')} AS sample_id, {ts('time')} AS time,
  {big('point_id')} AS point_id, {rd('direct_sw')} AS a, {rd('diffuse_sw')} AS b FROM fx_at
UNION ALL
SELECT 'profile', {big('sample_id')}, {ts('time')}, {big('point_id')}, {rd('swe')}, {rd('n_layers')}
FROM fx_sample WHERE n_layers > 0"""))
def _(spark, sf):
    forcing, profile = A_inputs.read_inputs(
        spark, stored.inputs(spark, sf), stored.RAW_FORCING, stored.RAW_PROFILE
    )
    present = F.size(F.array_compact("dz")).cast("double")
    keys = ["sample_id", "time", "point_id"]
    return union_all([
        forcing.select(F.lit("forcing").alias("side"), *keys,
                       F.col("direct_sw").alias("a"), F.col("diffuse_sw").alias("b")),
        profile.select(F.lit("profile").alias("side"), *keys,
                       F.col("swe").alias("a"), present.alias("b")),
    ])


def _files(spark, sf):
    """File names of every region and season; sparse seasons have no profile file."""
    groups = views.forcing_at_points(spark, sf).groupBy("geo", "season").agg(
        F.count(F.lit(1)).alias("n")
    )
    years = F.split("season", "_")
    dates = F.concat(F.lit("_"), years[0], F.lit("080106_"), years[1], F.lit("080106.nc"))
    return union_all([
        groups.select("geo", F.concat(F.lit("FORCING"), dates).alias("name")),
        groups.where(F.col("n") >= 12).select("geo", F.concat(F.lit("PRO"), dates).alias("name")),
    ])


_FILES = """
fx_file AS (
  SELECT geo, season, count(*) AS n, '_' || replace(season, '_', '080106_') || '080106.nc' AS dates
  FROM fx_at GROUP BY geo, season)"""


@query("a2_pair_inputs", sql("""
SELECT geo, season, 'FORCING' || dates AS forcing, CASE WHEN n >= 12 THEN 'PRO' || dates END AS profile
FROM fx_file""", _FILES))
def _(spark, sf):
    return A_inputs.pair_inputs(_files(spark, sf))


@query("a2_missing_partners", sql("""
SELECT geo, season, 'FORCING' || dates AS forcing FROM fx_file WHERE n < 12""", _FILES))
def _(spark, sf):
    return A_inputs.missing_partners(A_inputs.pair_inputs(_files(spark, sf)))


@query("a3_prune", f"""
SELECT {big('l_orderkey')} AS l_orderkey, {rd('l_quantity')} AS l_quantity FROM lineitem""")
def _(spark, sf):
    return B.prune(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity"])


_ROW = f"""geo, season, {big('month')} AS month, {big('sample_id')} AS sample_id, {ts('time')} AS time,
  {rd('albedo', 9)} AS albedo, {rd('thickness', 9)} AS thickness, {big('n_layers')} AS n_layers,
  {rd('surface_ssa', 9)} AS surface_ssa, {rd('cos_sza')} AS cos_sza"""
_ROW_COLUMNS = ["geo", "season", "month", "sample_id", "time", "albedo", "thickness",
                "n_layers", "surface_ssa", "round(cos_sza, 6) AS cos_sza"]


def stored_samples(spark, sf):
    return A_samples.read_samples(spark, stored.samples(spark, sf), stored.KEYED_SAMPLES)


@query("a4_read_samples", sql(f"SELECT {_ROW} FROM fx_sample"), digits=9)
def _(spark, sf):
    return stored_samples(spark, sf).selectExpr(*_ROW_COLUMNS)


@query("a5_pushed_predicates", sql(f"""
SELECT {_ROW} FROM fx_sample WHERE massif_number = 3 AND slope = 0 AND aspect = -1
  AND surface_ssa <= 60 AND season = '1997_1998'"""), digits=9)
def _(spark, sf):
    site = B.at_site(stored_samples(spark, sf), 3, slope=0, aspect=-1)
    return site.where((F.col("surface_ssa") <= 60) & (F.col("season") == "1997_1998")).selectExpr(
        *_ROW_COLUMNS
    )


_UNITS = f"SELECT geo, season, {big('month')} AS month, count(*) AS n FROM fx_at"


@query("a6_scan_units", sql(f"{_UNITS} GROUP BY ALL"))
def _(spark, sf):
    return A_samples.scan_units(stored_samples(spark, sf))


@query("a7_write_samples", sql(f"""
{_UNITS} WHERE season <> '1995_1996' OR month >= 8 GROUP BY ALL"""))
def _(spark, sf):
    table, root = stored.keyed_samples(spark, sf), scratch_path(spark, "rewritten")
    A_samples.write_samples(table, root)
    again = table.where((F.col("season") == "1995_1996") & (F.col("month") >= 8))
    A_samples.write_samples(again, root)
    return A_samples.scan_units(A_samples.read_samples(spark, root, stored.KEYED_SAMPLES))


@query("a8_metadata", sql(f"""
SELECT 'layered samples' AS description, 'orders' AS forcing, 'run-1' AS run_id,
  {ts('min(time)')} AS start, {ts('max(time)')} AS "end", count(*) AS n,
  'snow albedo' AS albedo_label, 'snow layer thickness (m)' AS dz_label FROM fx_sample"""))
def _(spark, sf):
    root = scratch_path(spark, "labelled")
    A_samples.with_metadata(views.samples(spark, sf).select("time", "dz", "albedo")).write.parquet(root)
    table = spark.read.parquet(root)
    labels = A_samples.labels_of(table)
    row = A_samples.manifest(table, "layered samples", {"FORCING": "orders"}, {"id": "run-1"})
    return row.select(
        "description", F.col("sources")["FORCING"].alias("forcing"), F.col("run")["id"].alias("run_id"),
        "start", "end", "n", F.lit(labels["albedo"]).alias("albedo_label"),
        F.lit(labels["dz"]).alias("dz_label"),
    )


def stored_units(spark, sf):
    """The ledger's rows of the whole sample table: no sample is read."""
    return A_ledger.units(spark, stored.samples(spark, sf))


@query("a6_ledger_units", sql(f"{_UNITS} GROUP BY ALL"))
def _(spark, sf):
    return A_ledger.unit_sizes(stored_units(spark, sf))


@query("a9_catalog_units", sql(f"SELECT geo, season, {big('month')} AS month FROM fx_unit"))
def _(spark, sf):
    return A_samples.catalog(stored_units(spark, sf))


_MONTHS = """
fx_months AS (
  SELECT geo, season, array_to_string(list(month ORDER BY (month + 4) % 12), ',') AS months
  FROM fx_unit GROUP BY geo, season)"""


@query("a9_catalog_seasons", sql("SELECT geo, season, months FROM fx_months", _MONTHS))
def _(spark, sf):
    seasons = A_samples.catalog(stored_units(spark, sf), "season")
    return seasons.select("geo", "season", F.array_join("months", ",").alias("months"))


@query("a9_catalog_geos", sql("""
SELECT geo, string_agg(season || ':' || months, ';' ORDER BY season) AS seasons
FROM fx_months GROUP BY geo""", _MONTHS))
def _(spark, sf):
    text = F.transform(
        "seasons", lambda s: F.concat_ws(":", s["season"], F.array_join(s["months"], ","))
    )
    geos = A_samples.catalog(stored_units(spark, sf), "geo")
    return geos.select("geo", F.array_join(text, ";").alias("seasons"))


@query("a10_read_season", sql(f"""
SELECT {_ROW} FROM fx_sample WHERE geo = 'ASIA' AND season = '1996_1997'"""), digits=9)
def _(spark, sf):
    root = stored.samples(spark, sf)
    return A_samples.read_season(spark, root, "ASIA", "1996_1997", stored.KEYED_SAMPLES).selectExpr(*_ROW_COLUMNS)


@query("a11_describe_selection", sql("""
SELECT *, row_number() OVER (ORDER BY geo, y1) AS position FROM (
  SELECT DISTINCT geo, split_part(season, '_', 1) AS y1, split_part(season, '_', 2) AS y2 FROM fx_at)"""))
def _(spark, sf):
    return placed(A_samples.describe_selection(stored_units(spark, sf)))


# Nine digits: at six, some of these means lie exactly between two roundings.
_STAT_ROWS = f"SELECT variable, {big('n')} AS n, {rd('mean', 9)} AS mean, {rd('std', 9)} AS std FROM fx_stat"


@query("a12_stats_store", sql(_STAT_ROWS), digits=9)
def _(spark, sf):
    path = scratch_path(spark, "stats")
    table = stored_samples(spark, sf)
    A_stores.save_stats(fit_stats(table), A_stores.group_sizes(table), path)
    stats, _ = A_stores.load_stats(spark, path)
    return stats


_FEATURE_SUM = """
fx_feature AS (
  SELECT sample_id, albedo, direct_sw, diffuse_sw, cos_sza, thickness,
    list_sum([x.i * CAST(CAST(coalesce(x.v, 0) AS FLOAT) AS DOUBLE) FOR x IN
      list_transform(generate_series(1, %(n)d), lambda k: {'i': k, 'v': flat[k]})]) AS snow_sum
  FROM (SELECT s.*, list_concat(
      list_transform(dz, lambda x: CASE WHEN x IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END),
      %(parts)s) AS flat FROM fx_sample s, fx_norm))""" % {
    "n": 6 * L,
    "parts": ", ".join(
        f"list_transform({v}, lambda x: (x - {v}_mean) / {v}_std)"
        for v in ("dz", "ssa", "density", "conc_soot", "conc_dust")
    ),
}
FEATURE_SUM = _FEATURE_SUM


def weighted_sum(flat):
    """Sum of position times value: changes whenever two entries trade places.

    Added up in the order of the entries over a whole batch of rows; a missing
    entry, or a missing array, makes it missing.
    """
    def run(batches):
        for column in batches:
            sizes = column.value_lengths().fill_null(0).to_numpy()
            values = column.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(1, len(row) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            weighted = place * values.to_numpy(zero_copy_only=False).astype("float64", copy=False)
            gone = column.is_null().to_numpy(zero_copy_only=False)
            if values.null_count:
                gone[row[values.is_null().to_numpy(zero_copy_only=False)]] = True
            yield pa.array(np.bincount(row, weighted, len(sizes)), mask=gone)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(flat)


@query("a13_cached_features", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('CAST(albedo AS FLOAT)', 4)} AS y, {rd('snow_sum', 4)} AS snow_sum
FROM fx_feature""", FEATURE_SUM), digits=4)
def _(spark, sf):
    table, path = stored_samples(spark, sf), scratch_path(spark, "features")
    norm = train_norm(spark, sf)
    A_stores.cached_features(table, norm, path, ("sample_id",), L)
    again = A_stores.cached_features(table, norm, path, ("sample_id",), L)
    return again.select("sample_id", "y", weighted_sum(F.flatten("x_snow")).alias("snow_sum"))


@query("a13_refreshed_features", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('CAST(albedo AS FLOAT)', 4)} AS y, {rd('snow_sum', 4)} AS snow_sum
FROM fx_feature""", FEATURE_SUM), digits=4)
def _(spark, sf):
    """Built from a table that lacks a season, then again from the whole one: only that season is added."""
    root, path = scratch_path(spark, "growing"), scratch_path(spark, "feature-view")
    table, norm, keys = stored_samples(spark, sf), train_norm(spark, sf), ("sample_id",)
    last = F.col("season") == table.agg(F.max("season")).first()[0]
    refresh = lambda: A_stores.refresh_features(spark, root, path, norm, keys, L, stored.KEYED_SAMPLES)
    A_samples.write_samples(table.where(~last), root)
    refresh()
    A_samples.write_samples(table.where(last), root)
    refresh()
    view = A_stores.read_features(spark, path, A_stores.feature_schema(keys, stored.KEYED_SAMPLES))
    return view.select("sample_id", "y", weighted_sum(F.flatten("x_snow")).alias("snow_sum"))


def train_norm(spark, sf) -> Norm:
    """Of the train split, from the moments in the ledger of the stored samples."""
    return fit_stored_norm(spark, stored.samples(spark, sf), views.plan(spark, sf))


_LOG = ", ".join(f"{rd(c, 8)} AS {c}" for c in (
    "learning_rate", "train_loss", "train_metric", "test_loss", "test_metric"))


@query("a14_append_log", sql(f"SELECT epoch, {_LOG} FROM fx_log"), digits=8)
def _(spark, sf):
    log, path = views.training_log(spark, sf), scratch_path(spark, "log")
    A_logs.append_log(log.where("epoch > 20"), path, fresh=True)
    A_logs.append_log(log.where("epoch <= 10"), path, fresh=True)
    A_logs.append_log(log.where("epoch > 10"), path)
    return A_logs.read_log(spark, path).select(*log.columns)


_NO = "CAST(NULL AS DOUBLE)"


_LOGS = sql(f"""
SELECT epoch, {_LOG}, {_NO} AS loss, {_NO} AS metric, 'current' AS log_shape FROM fx_log
UNION ALL
SELECT epoch, {_NO}, {rd('train_loss', 8)}, {rd('train_metric', 8)}, {rd('test_loss', 8)},
  {rd('test_metric', 8)}, {_NO}, {_NO}, 'four_metrics' FROM fx_log
UNION ALL
SELECT epoch, {_NO}, {_NO}, {_NO}, {_NO}, {_NO}, {rd('test_loss', 8)}, {rd('test_metric', 8)}, 'short'
FROM fx_log""")


@query("a15_read_logs", _LOGS, digits=8)
def _(spark, sf):
    log = views.training_log(spark, sf)
    short = log.select("epoch", F.col("test_loss").alias("loss"), F.col("test_metric").alias("metric"))
    paths = []
    for shape in (log, log.select(*LOG_FOUR_METRICS.names), short.select(*LOG_SHORT.names)):
        paths.append(scratch_path(spark, "log"))
        A_logs.append_log(shape, paths[-1], fresh=True)
    return A_logs.read_logs(spark, paths)


@query("a15_log_folder", _LOGS, digits=8)
def _(spark, sf):
    """Three shapes below one folder, read in one call."""
    log, root = views.training_log(spark, sf), scratch_path(spark, "logs")
    short = log.select("epoch", F.col("test_loss").alias("loss"), F.col("test_metric").alias("metric"))
    A_logs.append_log(log.where("epoch <= 20"), f"{root}/a", fresh=True)
    A_logs.append_log(log.where("epoch > 20"), f"{root}/a")
    A_logs.append_log(log.select(*LOG_FOUR_METRICS.names), f"{root}/b", fresh=True)
    A_logs.append_log(short.select(*LOG_SHORT.names), f"{root}/c/d", fresh=True)
    return A_logs.read_log_folder(spark, root).drop("log")


# --- filters and projections ---

_AT = f"SELECT {big('sample_id')} AS sample_id, {ts('time')} AS time, {rd('albedo', 9)} AS albedo FROM fx_at"
_AT_COLUMNS = ["sample_id", "time", "albedo"]


@query("b1_by_month", sql(f"{_AT} WHERE month(time) = 3"), digits=9)
def _(spark, sf):
    return B.by_month(views.forcing(spark, sf), 3).select(*_AT_COLUMNS)


@query("b2_first_patch", sql(f"{_AT} WHERE patch = 0"), digits=9)
def _(spark, sf):
    return B.first_patch(views.forcing(spark, sf)).select(*_AT_COLUMNS)


@query("b3_has_snow", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('swe')} AS swe FROM fx_sample WHERE swe > 0"""))
def _(spark, sf):
    return B.has_snow(views.samples(spark, sf)).select("sample_id", "swe")


@query("b4_is_daytime", sql(f"{_AT} WHERE direct_sw > 0 OR diffuse_sw > 0"), digits=9)
def _(spark, sf):
    return B.is_daytime(B.clean_missing(views.forcing(spark, sf))).select(*_AT_COLUMNS)


@query("b5_at_site", sql(f"{_AT} WHERE massif_number = 3 AND zs = 2700 AND slope = 0 AND aspect = -1"), digits=9)
def _(spark, sf):
    return B.at_site(views.forcing_at_points(spark, sf), 3, 2700, 0, -1).select(*_AT_COLUMNS)


@query("b6_between_times", sql(f"{_AT} WHERE time >= TIMESTAMP '1998-02-01' AND time < TIMESTAMP '1998-02-08'"), digits=9)
def _(spark, sf):
    return B.between_times(views.forcing(spark, sf), "1998-02-01", "1998-02-08").select(*_AT_COLUMNS)


@query("b7_find_profiles", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('surface_ssa', 9)} AS surface_ssa, {rd('albedo', 9)} AS albedo
FROM fx_sample WHERE surface_ssa <= 20 AND albedo >= 0.90"""), digits=9)
def _(spark, sf):
    found = B.find_profiles(views.samples(spark, sf), 20, 0.90)
    return found.select("sample_id", "surface_ssa", "albedo")


@query("b8_at_time_of_day", f"""
SELECT {big('event_id')} AS event_id, {ts('ts')} AS ts FROM events
WHERE strftime(ts, '%H:%M') = '12:00' AND second(ts) = 0
UNION ALL
SELECT {big('user_id')}, {ts("date_trunc('hour', ts)")} FROM events
WHERE strftime(date_trunc('hour', ts), '%H:%M:%S') = '12:00:00'""")
def _(spark, sf):
    from layerframe.functions.times import hour_start

    events = views.table(spark, sf, "events")
    hours = events.select(F.col("user_id").alias("event_id"), hour_start("ts").alias("ts"))
    exact = B.at_time_of_day(events.select("event_id", "ts"), "12:00:00", "ts")
    return union_all([exact, B.at_time_of_day(hours, "12:00:00", "ts")])


@query("b9_slice_times", sql(f"""
SELECT {big('event_id')} AS event_id, {ts('time')} AS time FROM fx_flux
WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"""))
def _(spark, sf):
    return B.slice_times(views.fluxes(spark, sf), "2024-01-05", "2024-01-20").select("event_id", "time")


@query("b10_at_point", sql(f"{_AT} WHERE point_id = 77"), digits=9)
def _(spark, sf):
    return B.at_point(views.forcing(spark, sf), 77).select(*_AT_COLUMNS)


_ID = f"""strftime(time, '%Y-%m-%dT%H:%M:%S.%f') || '000' AS time, {rd('zs')} AS "ZS",
  {rd('aspect')} AS aspect, {rd('slope')} AS slope, {big('massif_number')} AS massif_number"""


@query("b11_id_columns", sql(f"SELECT {_ID} FROM fx_at"))
def _(spark, sf):
    return B.identify(views.forcing_at_points(spark, sf))


@query("b12_wide_order", sql("SELECT " + ", ".join([
    _ID,
    *[f"CAST(dz[{i}] IS NOT NULL AS BIGINT) AS snow_layer{i}" for i in range(1, L + 1)],
    *[f"{rd(c, 9)} AS {c}" for c in ("direct_sw", "diffuse_sw", "albedo")],
    f"{rd('cos_sza')} AS cos_sza",
]) + " FROM fx_sample"), digits=9)
def _(spark, sf):
    wide = to_wide(views.samples(spark, sf), L).withColumn("cos_sza", F.round("cos_sza", 6))
    return B.drop_unneeded(wide, [
        c for c in wide.columns
        if not c.startswith(("dz", "ssa", "density", "conc_"))
    ])


@query("b13_scatter_points", sql(f"""
SELECT {rd('albedo', 10)} AS albedo, {rd('yhat', 10)} AS prediction, {rd('surface_density', 10)} AS surface_density
FROM fx_pred"""), digits=10)
def _(spark, sf):
    return B.scatter_points(views.predictions(spark, sf))


@query("b14_deposition", sql(f"""
SELECT {big('event_id')} AS event_id, {rd('(imp_dry1 + imp_wet1) * 3600')} AS soot_deposition,
  {rd('(imp_dry2 + imp_wet2) * 3600')} AS dust_deposition FROM fx_flux"""))
def _(spark, sf):
    return B.deposition(views.fluxes(spark, sf)).select("event_id", "soot_deposition", "dust_deposition")
