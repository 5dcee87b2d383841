"""Joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerframe.functions import sql as sql_functions
from layerframe.operators import aggregates as D
from layerframe.operators import features as I
from layerframe.operators import histograms as D_hist
from layerframe.operators import joins as C
from layerframe.operators import metrics as D_metrics
from layerframe.operators import stats as D_stats
from layerframe.operators.filters import deposition
from layerframe.operators.ordering import assign_batches, stored_order
from layerframe.operators.series import resample_sum
from layerframe.plans.ingest import build_samples
from layerframe.sources import ledger
from layerframe.sources.samples import catalog
from layerframe.functions.maths import linear_edges, log_edges

from . import stored, views
from .registry import query
from .section_ab import stored_samples, stored_units, train_norm
from .sql import L, big, rd, sql, ts


# --- joins ---

@query("c1_sync_times", sql(f"""
SELECT {big('sample_id')} AS sample_id, {ts('time')} AS time FROM fx_forcing
WHERE time IN (SELECT time FROM fx_sample WHERE n_layers > 0)"""))
def _(spark, sf):
    forcing = views.forcing(spark, sf)
    profile = forcing.join(views.layers(spark, sf), "sample_id", "left_semi")
    return C.sync_times(forcing, profile).select("sample_id", "time")


_BUILT = [
    "sample_id", "geo", "season", "month", "massif_number", "n_layers",
    "thickness", "swe", "surface_ssa", "surface_density", "surface_dust", "direct_sw",
    "diffuse_sw", "cos_sza", "albedo",
]


@query("c2_build_samples", sql(f"""
SELECT {big('sample_id')} AS sample_id, geo, season, {big('month')} AS month,
  {big('massif_number')} AS massif_number, {big('n_layers')} AS n_layers,
  {", ".join(f"{rd(c, 6 if c == 'cos_sza' else 9)} AS {c}" for c in _BUILT[6:])}
FROM fx_sample WHERE swe > 0 AND patch = 0 AND (direct_sw > 0 OR diffuse_sw > 0)"""), digits=9)
def _(spark, sf):
    built = build_samples(
        stored.raw_forcing(spark, sf), stored.raw_profile(spark, sf).drop("geo", "season"),
        views.points(spark, sf), ("time", "point_id", "sample_id"),
    )
    return built.select(*_BUILT).withColumn("cos_sza", F.round("cos_sza", 6))


@query("c2_duplicate_keys", sql(f"""
SELECT {ts('time')} AS time, {big('point_id')} AS point_id, count(*) AS copies FROM fx_forcing
GROUP BY time, point_id HAVING count(*) > 1"""))
def _(spark, sf):
    return C.duplicate_keys(views.forcing(spark, sf))


@query("c3_point_attributes", sql(f"""
SELECT {big('sample_id')} AS sample_id, geo, {big('massif_number')} AS massif_number,
  {", ".join(f"{rd(c)} AS {c}" for c in ("zs", "slope", "aspect", "lat", "lon"))} FROM fx_at"""))
def _(spark, sf):
    joined = C.with_point_attrs(views.forcing(spark, sf), views.points(spark, sf))
    return joined.select("sample_id", "geo", "massif_number", "zs", "slope", "aspect", "lat", "lon")


@query("c4_apply_norm", sql(f"""
SELECT {big('sample_id')} AS sample_id,
  {", ".join(f"{rd(f'({v} - {v}_mean) / {v}_std')} AS {v}" for v in ("direct_sw", "diffuse_sw", "albedo"))}
FROM fx_sample, fx_norm"""))
def _(spark, sf):
    norm = train_norm(spark, sf)
    scaled = I.normalize_target(I.normalize_sun(views.samples(spark, sf), norm), norm)
    return scaled.select("sample_id", "direct_sw", "diffuse_sw", "albedo")


@query("c5_assign_split", sql(f"""
SELECT {big('sample_id')} AS sample_id, geo, season, split FROM fx_labelled"""))
def _(spark, sf):
    at = views.forcing_at_points(spark, sf)
    return C.assign_split(at, views.plan(spark, sf)).select("sample_id", "geo", "season", "split")


# --- aggregates ---

@query("d1_partial_stats", sql(f"""
SELECT geo, season, variable, {big('count(x)')} AS n, {rd("sum(x) * CASE variable WHEN 'albedo' THEN 1000 ELSE 1 END")} AS total,
  {rd('avg(x * x)', 3)} AS mean_sq FROM fx_value GROUP BY geo, season, variable"""))
def _(spark, sf):
    partials = D_stats.partial_stats(views.samples(spark, sf))
    return partials.select(
        "geo", "season", "variable", "n",
        # Albedo has eight decimals: in thousandths its sums round without ties.
        (F.col("total") * F.when(F.col("variable") == "albedo", 1000).otherwise(1)).alias("total"),
        F.round(F.col("total_sq") / F.col("n"), 3).alias("mean_sq"),
    )


_STAT = f"SELECT variable, {big('n')} AS n, {rd('mean')} AS mean, {rd('std')} AS std"


@query("d2_merge_stats", sql(f"{_STAT} FROM fx_stat"))
def _(spark, sf):
    partials = D_stats.partial_stats(views.samples(spark, sf))
    return D_stats.finish_stats(D_stats.merge_stats(partials))


@query("d3_fit_stats", sql(f"{_STAT} FROM fx_train"))
def _(spark, sf):
    labelled = C.assign_split(views.samples(spark, sf), views.plan(spark, sf))
    return D_stats.fit_stats(labelled.where("split = 'train'"))


@query("d4_time_coverage", sql(f"""
SELECT geo, season, {big('month')} AS month, {ts('min(time)')} AS start, {ts('max(time)')} AS "end"
FROM fx_at GROUP BY geo, season, month"""))
def _(spark, sf):
    return D.time_coverage(views.forcing_at_points(spark, sf))


@query("d4_ledger_coverage", sql(f"""
SELECT geo, season, {big('month')} AS month, {ts('min(time)')} AS start, {ts('max(time)')} AS "end"
FROM fx_at GROUP BY geo, season, month"""))
def _(spark, sf):
    return ledger.coverage(stored_units(spark, sf))


_RESAMPLED = sql(f"""
SELECT {big('c.point_id')} AS point_id, {ts('c.month')} AS month, {rd('coalesce(s.direct_sw, 0)')} AS direct_sw
FROM (SELECT point_id, unnest(generate_series(min(date_trunc('month', time)::TIMESTAMP),
    max(date_trunc('month', time)::TIMESTAMP), INTERVAL 1 MONTH)) AS month FROM fx_forcing GROUP BY point_id) c
LEFT JOIN (SELECT point_id, date_trunc('month', time)::TIMESTAMP AS month, sum(direct_sw) AS direct_sw
  FROM fx_forcing GROUP BY ALL) s ON c.point_id = s.point_id AND c.month = s.month""")


@query("d5_resample_points", _RESAMPLED)
def _(spark, sf):
    return resample_sum(views.forcing(spark, sf), "time", ["direct_sw"], ["point_id"])


@query("d5_sql_resample", _RESAMPLED)
def _(spark, sf):
    sql_functions.register(spark)
    return spark.sql("""
        SELECT c.point_id, c.month, coalesce(s.direct_sw, 0D) AS direct_sw FROM (
          SELECT point_id, m.month FROM (SELECT point_id, min(time) AS since, max(time) AS until FROM {forcing} GROUP BY point_id),
            LATERAL month_starts(since, until) AS m) c
        LEFT JOIN (SELECT point_id, month_start(time) AS month, sum(direct_sw) AS direct_sw FROM {forcing} GROUP BY ALL) s
          ON c.point_id = s.point_id AND c.month = s.month""", forcing=views.forcing(spark, sf))


@query("d5_monthly_deposition", sql(f"""
SELECT {ts("date_trunc('month', time)")} AS month,
  {rd('sum((imp_dry1 + imp_wet1) * 3600)', 2)} AS soot_deposition,
  {rd('sum((imp_dry2 + imp_wet2) * 3600)', 2)} AS dust_deposition FROM fx_flux GROUP BY 1"""), digits=2)
def _(spark, sf):
    return resample_sum(
        deposition(views.fluxes(spark, sf)), "time", ["soot_deposition", "dust_deposition"]
    )


def _histogram_sql(edges: str, values: str, low: str = "b.low", high: str = "b.high") -> str:
    """Counts between listed edges; the last bin takes its right edge as well."""
    return sql(f"""
SELECT b.variable, {big('b.bin')} AS bin, {rd(low, 9)} AS low, {rd(high, 9)} AS high, count(v.x) AS count
FROM b LEFT JOIN v ON v.variable = b.variable AND v.x >= b.low
  AND (v.x < b.high OR (v.x = b.high AND b.bin = b.last)) GROUP BY ALL""",
        f"v AS ({values})",
        f"e AS ({edges})",
        """b AS (SELECT variable, k - 1 AS bin, len(edges) - 2 AS last, edges[k] AS low, edges[k + 1] AS high
  FROM (SELECT variable, edges, unnest(generate_series(1, len(edges) - 1)) AS k FROM e))""")


def _list(edges) -> str:
    return "[" + ", ".join(f"CAST({e!r} AS DOUBLE)" for e in edges) + "]"


_BOTH = "SELECT 'albedo' AS variable, albedo AS x FROM fx_pred UNION ALL SELECT 'yhat', yhat FROM fx_pred"


@query("d6_histogram", _histogram_sql(
    f"SELECT DISTINCT variable, {_list(linear_edges(0, 0.99, 200))} AS edges FROM v", _BOTH), digits=9)
def _(spark, sf):
    return D_hist.histogram(views.predictions(spark, sf), ["albedo", "yhat"], 200, 0, 0.99)


@query("d6_sql_histogram", _histogram_sql(
    f"SELECT DISTINCT variable, {_list(linear_edges(0, 0.99, 200))} AS edges FROM v", _BOTH), digits=9)
def _(spark, sf):
    sql_functions.register(spark)
    return spark.sql("""
        WITH seen AS (SELECT variable, histogram_bin(x, 0D, 0.99D, 200) AS bin, count(*) AS n
          FROM (SELECT stack(2, 'albedo', albedo, 'yhat', yhat) AS (variable, x) FROM {rows}) GROUP BY ALL)
        SELECT v.variable, b.bin, b.low_edge AS low, b.high_edge AS high, coalesce(n, 0L) AS count
        FROM histogram_bins(0D, 0.99D, 200) AS b JOIN (VALUES ('albedo'), ('yhat')) AS v(variable)
          LEFT JOIN seen ON seen.variable = v.variable AND seen.bin = b.bin""", rows=views.predictions(spark, sf))


@query("d7_log_histogram", _histogram_sql(
    f"SELECT 'dust' AS variable, {_list(log_edges(-21, 0, 200))} AS edges",
    "SELECT 'dust' AS variable, conc_dust * pow(CAST(10 AS DOUBLE), -2 * layer) AS x FROM fx_layer",
    "log10(b.low)", "log10(b.high)"), digits=9)
def _(spark, sf):
    dust = F.col("conc_dust") * F.pow(F.lit(10.0), F.col("layer") * -2)
    counts = D_hist.log_histogram(
        views.layers(spark, sf).select(dust.alias("dust")), "dust", -21, 0, 200
    )
    return counts.withColumns({"low": F.log10("low"), "high": F.log10("high")})


@query("d8_auto_histogram", _histogram_sql("""
SELECT variable, list_transform(generate_series(0, 50), lambda k:
  CASE WHEN k = 50 THEN high ELSE low + k * ((high - low) / 50) END) AS edges
FROM (SELECT variable, min(x) AS low, max(x) AS high FROM v GROUP BY variable)""", _BOTH), digits=9)
def _(spark, sf):
    return D_hist.histogram(views.predictions(spark, sf), ["albedo", "yhat"], 50)


_STORED = ("SELECT 'albedo' AS variable, albedo AS x FROM fx_sample UNION ALL"
           " SELECT 'surface_density', surface_density FROM fx_sample")


@query("d8_stored_histogram", _histogram_sql("""
SELECT variable, list_transform(generate_series(0, 50), lambda k:
  CASE WHEN k = 50 THEN high ELSE low + k * ((high - low) / 50) END) AS edges
FROM (SELECT variable, min(x) AS low, max(x) AS high FROM v GROUP BY variable)""", _STORED), digits=9)
def _(spark, sf):
    columns = ["albedo", "surface_density"]
    ends = ledger.stored_spans(stored_units(spark, sf), columns)
    return D_hist.histogram(stored_samples(spark, sf), columns, 50, ends=ends)


BATCH = 256
BATCHES = f"""
fx_batch AS (
  SELECT batch_id, count(*) AS n, avg((albedo - yhat) * (albedo - yhat)) AS loss FROM (
    SELECT albedo, yhat, (row_number() OVER (
      ORDER BY geo, season, (month + 4) % 12, time, point_id, sample_id) - 1) // {BATCH} AS batch_id
    FROM fx_pred) GROUP BY batch_id)"""


def batches(spark, sf):
    rows = views.predictions(spark, sf).select(
        "geo", "season", "month", "time", "point_id", "sample_id", "albedo", "yhat"
    )
    return assign_batches(rows, BATCH, stored_order("time", "point_id", "sample_id"))


@query("d9_mean_loss", sql(f"SELECT {rd('sum(loss * n) / sum(n)', 9)} AS mean_loss FROM fx_batch", BATCHES),
       digits=9)
def _(spark, sf):
    return D_metrics.mean_loss(D_metrics.batch_losses(batches(spark, sf)))


_ERRORS = {
    "mse": "avg((albedo - yhat) * (albedo - yhat))",
    "mae": "avg(abs(albedo - yhat))",
    "rmse": "sqrt(avg((albedo - yhat) * (albedo - yhat)))",
}


def _register_error(number: int, name: str, measure) -> None:
    @query(f"d{number}_{name}", sql(
        f"SELECT geo, season, {rd(_ERRORS[name], 9)} AS {name} FROM fx_pred GROUP BY geo, season"),
        digits=9)
    def _(spark, sf):
        predicted = views.predictions(spark, sf)
        return predicted.groupBy("geo", "season").agg(measure().alias(name))


_register_error(10, "mse", D_metrics.mse)
_register_error(11, "mae", D_metrics.mae)
_register_error(12, "rmse", D_metrics.rmse)


@query("d13_best_trial", sql(f"""
SELECT {big('epoch')} AS epoch, {rd('learning_rate', 8)} AS learning_rate, {rd('train_loss', 8)} AS train_loss,
  {rd('train_metric', 8)} AS train_metric, {rd('test_loss', 8)} AS test_loss,
  {rd('test_metric', 8)} AS test_metric FROM fx_log ORDER BY test_loss LIMIT 1"""), digits=8)
def _(spark, sf):
    return D_metrics.best_trial(views.training_log(spark, sf), "test_loss")


@query("d14_value_range", sql(f"""
SELECT geo, {rd('min(surface_density)')} AS low, {rd('max(surface_density)')} AS high FROM fx_sample GROUP BY geo"""))
def _(spark, sf):
    return D.value_range(views.samples(spark, sf), "surface_density", ["geo"])


@query("d14_ledger_range", sql(f"""
SELECT geo, {rd('min(surface_density)')} AS low, {rd('max(surface_density)')} AS high FROM fx_sample GROUP BY geo"""))
def _(spark, sf):
    return ledger.stored_range(stored_units(spark, sf), "surface_density", ["geo"])


@query("d15_check_complete", sql("""
SELECT geo, season, count(DISTINCT month) AS months FROM fx_at GROUP BY geo, season
HAVING count(DISTINCT month) < 12"""))
def _(spark, sf):
    return D.check_complete(catalog(views.forcing_at_points(spark, sf)))
