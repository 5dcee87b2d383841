"""The composed queries, and what a stored table keeps beside its samples."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from layerframe.operators import nets, scoring, stats
from layerframe.plans import analysis
from layerframe.plans.ingest import ingest
from layerframe.session import scratch_path
from layerframe.sources.samples import read_manifest, read_samples

from . import stored, views
from .registry import query
from .section_ijk import NARROW_NET, L, net_steps, train_norm
from .sql import big, rd, sql, ts

SITE = {"massif_number": 3, "zs": 2700.0}
SITE_SQL = "massif_number = 3 AND zs = 2700"
GEO, SEASON = "EUROPE", "1995_1996"


def _site() -> dict[str, float]:
    return {"massif": SITE["massif_number"], "zs": SITE["zs"]}


def _bins(source: str) -> list[str]:
    """Counts on 200 bins over [0, 0.99] of target and prediction."""
    return [f"""
edges AS (SELECT v.variable, b.bin, CAST(0.99 AS DOUBLE) * b.bin / 200 AS low, CAST(0.99 AS DOUBLE) * (b.bin + 1) / 200 AS high
  FROM (SELECT unnest(generate_series(0, 199)) AS bin) b, (SELECT unnest(['albedo', 'yhat']) AS variable) v)""", f"""
shown AS (SELECT 'albedo' AS variable, albedo AS x FROM {source} UNION ALL SELECT 'yhat', yhat FROM {source})""", """
tallied AS (SELECT e.variable, e.bin, e.low, e.high, count(s.x) AS count FROM edges e
  LEFT JOIN shown s ON s.variable = e.variable AND s.x >= e.low AND (s.x < e.high OR (e.bin = 199 AND s.x <= e.high))
  GROUP BY ALL)"""]


@query("p1_site_series", sql(f"""
SELECT {ts('time')} AS time, {rd('albedo', 4)} AS albedo, {rd('yhat', 4)} AS yhat, {rd('rmse', 4)} AS rmse
FROM (SELECT time, albedo, yhat FROM chosen UNION ALL SELECT unnest(between_), NULL, NULL FROM holes),
  (SELECT sqrt(avg(pow(albedo - yhat, 2))) AS rmse FROM chosen)""", *net_steps(NARROW_NET), f"""
chosen AS (SELECT f.time, f.albedo, s.yhat FROM fx_sample f JOIN scored s USING (sample_id)
  WHERE {SITE_SQL} AND f.time >= '1994-01-01' AND f.time < '1997-01-01')""", """
holes AS (SELECT generate_series(a + INTERVAL 1 DAY, b - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY) AS between_ FROM (
  SELECT time AS a, lead(time) OVER (ORDER BY time) AS b FROM (SELECT DISTINCT time FROM chosen)) WHERE b > a + INTERVAL 1 DAY)"""),
digits=4)
def _(spark, sf):
    return analysis.site_series(
        views.samples(spark, sf), train_norm(spark, sf), nets.waves(NARROW_NET, L), _site(),
        "1994-01-01", "1997-01-01", NARROW_NET, timedelta(days=1), L,
    )


@query("p2_prediction_distribution", sql(f"""
SELECT variable, {big('bin')} AS bin, {rd('low', 9)} AS low, {rd('high', 9)} AS high, count, {rd('rmse', 4)} AS rmse
FROM tallied, (SELECT sqrt(avg(pow(albedo - yhat, 2))) AS rmse FROM chosen)""", *net_steps(NARROW_NET), f"""
chosen AS (SELECT f.albedo, s.yhat FROM fx_sample f JOIN scored s USING (sample_id)
  WHERE geo = '{GEO}' AND season = '{SEASON}')""", *_bins("chosen")), digits=9)
def _(spark, sf):
    shown = analysis.prediction_distribution(
        views.samples(spark, sf), train_norm(spark, sf), nets.waves(NARROW_NET, L), GEO, SEASON, NARROW_NET, L
    )
    return shown.withColumn("rmse", F.round("rmse", 4))


_AT_SITE = f"""
chosen AS (SELECT f.sample_id, f.albedo, f.surface_density, s.yhat FROM fx_sample f JOIN scored s USING (sample_id)
  WHERE {SITE_SQL})"""


def _scatter(spark, sf):
    return analysis.scatter_with_margins(
        views.samples(spark, sf), train_norm(spark, sf), nets.waves(NARROW_NET, L), _site(), NARROW_NET,
        ("sample_id",), L,
    )


@query("p3_scatter_points", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('albedo', 4)} AS albedo, {rd('yhat', 4)} AS prediction,
  {rd('surface_density', 4)} AS surface_density FROM chosen""", *net_steps(NARROW_NET), _AT_SITE), digits=4)
def _(spark, sf):
    return _scatter(spark, sf)[0]


@query("p3_scatter_margins", sql(f"""
SELECT variable, {big('bin')} AS bin, {rd('low', 9)} AS low, {rd('high', 9)} AS high, count FROM tallied""",
*net_steps(NARROW_NET), _AT_SITE, *_bins("chosen")), digits=9)
def _(spark, sf):
    return _scatter(spark, sf)[1]


# The busiest user, so that the series reaches beyond both ends of the slice.
@query("p4_point_deposition", sql(f"""
SELECT {ts("date_trunc('month', time)")} AS month, {rd('sum((imp_dry1 + imp_wet1) * 3600)', 2)} AS soot_deposition,
  {rd('sum((imp_dry2 + imp_wet2) * 3600)', 2)} AS dust_deposition FROM fx_flux, inner_span
WHERE point_id = 1 AND time BETWEEN low AND high GROUP BY 1""", """
inner_span AS (SELECT min(time) + INTERVAL 1 HOUR AS low, max(time) - INTERVAL 1 HOUR AS high FROM fx_flux WHERE point_id = 1)"""),
digits=2)
def _(spark, sf):
    fluxes = views.fluxes(spark, sf)
    span = fluxes.where("point_id = 1").agg(F.min("time").alias("low"), F.max("time").alias("high")).first()
    hour = timedelta(hours=1)
    return analysis.point_deposition(fluxes, 1, span["low"] + hour, span["high"] - hour)


# --- a whole ingest, read back ---

_PAIRED = """
paired AS (SELECT * FROM fx_sample WHERE n_layers > 0 AND patch = 0 AND swe > 0 AND (direct_sw > 0 OR diffuse_sw > 0))"""

_ingested: dict[tuple[str, str], str] = {}


def _stored(spark, sf) -> str:
    memo = (spark.sparkContext.applicationId, sf)
    if memo not in _ingested:
        out = scratch_path(spark, "ingested")
        inputs, points = stored.unique_inputs(spark, sf)
        ingest(spark, inputs, points, out, run={"id": "run-1"})
        _ingested[memo] = out
    return _ingested[memo]


# Every order has a key of its own: the n-th of a time and point is a further point at the same place.
_UNIQUE = f"""
uniq AS (SELECT sample_id, point_id + {stored.TWIN} * (row_number() OVER (PARTITION BY time, point_id ORDER BY sample_id) - 1) AS own_id
  FROM fx_at)"""


@query("c2_ingest", sql(f"""
SELECT {ts('time')} AS time, {big('own_id')} AS point_id, geo, season, {big('month')} AS month,
  {rd('albedo')} AS albedo, {rd('thickness')} AS thickness, {big('n_layers')} AS n_layers, {rd('surface_ssa')} AS surface_ssa
FROM paired JOIN uniq USING (sample_id)""", _PAIRED, _UNIQUE))
def _(spark, sf):
    table = read_samples(spark, _stored(spark, sf))
    return table.select("time", "point_id", "geo", "season", "month", "albedo", "thickness", "n_layers", "surface_ssa")


@query("a8_ingest_manifest", sql(f"""
SELECT 'run-1' AS run_id, {ts('min(time)')} AS start, {ts('max(time)')} AS "end", count(*) AS n,
  {rd('(SELECT min(step) FROM steps)')} AS resolution FROM paired""", _PAIRED, """
steps AS (SELECT epoch(time - lag(time) OVER (PARTITION BY geo, season ORDER BY time)) AS step
  FROM (SELECT DISTINCT geo, season, time FROM paired))"""))
def _(spark, sf):
    row = read_manifest(spark, _stored(spark, sf))
    return row.select(F.col("run")["id"].alias("run_id"), "start", "end", "n", "resolution")


# --- stored statistics and weights ---

@query("d3_published_layout", sql(f"""
SELECT statistic, {", ".join(f"{rd(f'max(CASE WHEN variable = {chr(39)}{v}{chr(39)} THEN x END)', 9)} AS {v}" for v in stats.STAT_VARS)}
FROM (SELECT 'mean' AS statistic, variable, mean AS x FROM fx_stat UNION ALL SELECT 'std', variable, std FROM fx_stat)
GROUP BY statistic"""), digits=9)
def _(spark, sf):
    path = scratch_path(spark, "wide-stats")
    stats.stats_to_wide(stats.fit_stats(views.samples(spark, sf))).write.parquet(path)
    return spark.read.parquet(path)


@query("k1_stored_weights", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('yhat', 4)} AS yhat FROM scored""", *net_steps(NARROW_NET)), digits=4)
def _(spark, sf):
    """Every sample, scored with weights that went through a table."""
    path = scratch_path(spark, "weights")
    scoring.save_parameters(spark, nets.waves(NARROW_NET, L, "float64"), path)
    weights = scoring.load_parameters(spark, path, NARROW_NET, L, "float64")
    # Doubles all the way: the comparison is about the arithmetic, not float32.
    scored = scoring.score_profiles(views.samples(spark, sf), train_norm(spark, sf), NARROW_NET, weights, L, dtype="float64")
    return scored.select("sample_id", "yhat")
