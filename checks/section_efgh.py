"""Order-dependent operators, sorting, set operations and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layerframe.functions import sql as sql_functions
from layerframe.functions.times import DAY, HOUR, season_order
from layerframe.operators import ordering as E
from layerframe.operators import profiles as E_profiles
from layerframe.operators import series as E_series
from layerframe.operators import sets as G
from layerframe.operators import splits as H
from layerframe.operators.filters import by_month, drop_unneeded, find_profiles, prune
from layerframe.operators.joins import assign_split
from layerframe.operators.metrics import batch_losses
from layerframe.operators.splits import split_ratio
from layerframe.session import scratch_path
from layerframe.sources.samples import catalog
from layerframe.sources.stores import load_stats, refresh_stats, refresh_stored_stats

from . import stored, views
from .registry import placed, query
from .section_ab import stored_samples, stored_units
from .section_cd import BATCH, BATCHES, batches
from .sql import L, big, rd, sql, ts


def _gap_sql(view: str, step: str) -> str:
    return sql(f"""
SELECT {big('user_id')} AS user_id, {ts('time')} AS time, {rd('value')} AS value FROM {view}
UNION ALL
SELECT {big('user_id')}, {ts('u.time')}, CAST(NULL AS DOUBLE) FROM (
  SELECT user_id, time AS a, lead(time) OVER (PARTITION BY user_id ORDER BY time) AS b FROM {view}) g,
  LATERAL (SELECT unnest(generate_series(g.a + {step}, g.b - INTERVAL 1 MICROSECOND, {step})) AS time) u
WHERE g.b > g.a + {step}""")


@query("e1_fill_hours", _gap_sql("fx_hourly", "INTERVAL 1 HOUR"))
def _(spark, sf):
    return E_series.fill_gaps(views.hourly(spark, sf), "time", HOUR, ["user_id"])


# The same from SQL text: the functions of layerframe.functions.sql, no DataFrame call.
@query("e1_sql_fill_hours", _gap_sql("fx_hourly", "INTERVAL 1 HOUR"))
def _(spark, sf):
    sql_functions.register(spark)
    return spark.sql("""
        SELECT user_id, time, value FROM {series} UNION ALL
        SELECT user_id, g.time, CAST(NULL AS DOUBLE) FROM (
          SELECT user_id, time, lead(time) OVER (PARTITION BY user_id ORDER BY time) AS next FROM {series}) s,
          LATERAL gaps(s.time, s.next, INTERVAL '1' HOUR) AS g""", series=views.hourly(spark, sf))


@query("e2_fill_days", _gap_sql("fx_daily", "INTERVAL 1 DAY"))
def _(spark, sf):
    return E_series.fill_gaps(views.daily(spark, sf), "time", DAY, ["user_id"])


_BOXES = """
fx_box AS (
  SELECT sample_id, row_number() OVER up - 1 AS level, sum(dz) OVER up - dz AS z_bottom,
    sum(dz) OVER up AS z_top, ssa AS value, ssa_low, ssa_high FROM (
    SELECT *, min(ssa) OVER w AS ssa_low, max(ssa) OVER w AS ssa_high FROM fx_layer
    WINDOW w AS (PARTITION BY sample_id))
  WINDOW up AS (PARTITION BY sample_id ORDER BY layer DESC ROWS UNBOUNDED PRECEDING)),
fx_shade AS (
  SELECT *, CASE WHEN ssa_low = ssa_high THEN CAST(0 AS DOUBLE)
    ELSE (value - ssa_low) / (ssa_high - ssa_low) END AS shade FROM fx_box)"""


@query("e3_layer_boundaries", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big('level')} AS level, {rd('z_bottom')} AS z_bottom,
  {rd('z_top')} AS z_top, {rd('value')} AS value, {rd('shade')} AS shade FROM fx_shade""", _BOXES))
def _(spark, sf):
    return E_profiles.layer_boundaries(views.profiles(spark, sf), "ssa")


@query("e4_running_loss", sql(f"""
SELECT {big('batch_id')} AS batch_id, {big('n')} AS n, {rd('loss', 9)} AS loss,
  {rd('sum(loss * n) OVER w / sum(n) OVER w', 9)} AS running_loss FROM fx_batch
WINDOW w AS (ORDER BY batch_id ROWS UNBOUNDED PRECEDING)""", BATCHES), digits=9)
def _(spark, sf):
    return E.running_loss(batch_losses(batches(spark, sf)))


@query("e5_assign_batches", sql(f"""
SELECT {big('sample_id')} AS sample_id, {big(f'(rn - 1) // {BATCH}')} AS batch_id, {big('rn - 1')} AS row_id FROM (
  SELECT sample_id, row_number() OVER (
    ORDER BY geo, season, (month + 4) % 12, time, point_id, sample_id) AS rn FROM fx_pred)"""))
def _(spark, sf):
    return batches(spark, sf).select("sample_id", "batch_id", "row_id")


_RANKED = """
fx_place AS (
  SELECT *, row_number() OVER (ORDER BY geo, season, (month + 4) % 12) - 1 AS unit, count(*) OVER () AS total
  FROM fx_unit)"""


def _register_shards(name: str, workers: int) -> None:
    @query(name, sql(f"""
SELECT geo, season, {big('month')} AS month, {big('unit')} AS unit,
  {big(f'unit // ((total + {workers - 1}) // {workers})')} AS shard FROM fx_place""", _RANKED))
    def _(spark, sf):
        return E.assign_shards(views.units(spark, sf), workers)


_register_shards("e6_assign_shards", 4)
_register_shards("e6_more_workers_than_units", 1000)


# --- sorting and limits ---

@query("f1_season_order", sql(f"""
SELECT geo, season, {big('month')} AS month, {big('(month + 4) % 12')} AS place,
  rank() OVER (ORDER BY (month + 4) % 12) AS first_position,
  count(*) OVER (ORDER BY (month + 4) % 12) AS last_position FROM fx_unit"""))
def _(spark, sf):
    ordered = placed(E.by_season_order(views.units(spark, sf)).withColumn("place", season_order("month")))
    month = W.partitionBy("place")
    return ordered.select(
        "geo", "season", "month", "place", F.min("position").over(month).alias("first_position"),
        F.max("position").over(month).alias("last_position"),
    )


@query("f2_first_profile", sql(f"""
SELECT {big('sample_id')} AS sample_id, {ts('time')} AS time, {rd('surface_ssa', 9)} AS surface_ssa,
  {rd('albedo', 9)} AS albedo FROM fx_sample WHERE surface_ssa <= 20 AND albedo >= 0.90
ORDER BY fx_sample.time, point_id, fx_sample.sample_id LIMIT 1"""), digits=9)
def _(spark, sf):
    found = find_profiles(views.samples(spark, sf), 20, 0.90)
    first = E_profiles.first_profile(found, ["time", "point_id", "sample_id"])
    return first.select("sample_id", "time", "surface_ssa", "albedo")


@query("f3_preview", sql(f"""
SELECT {big('sample_id')} AS sample_id, {rd('albedo', 9)} AS albedo FROM fx_forcing
ORDER BY time, point_id, fx_forcing.sample_id LIMIT {BATCH}"""), digits=9)
def _(spark, sf):
    rows = E_profiles.preview(views.forcing(spark, sf), BATCH, ["time", "point_id", "sample_id"])
    return rows.select("sample_id", "albedo")


@query("f4_shuffle_units", sql("""
SELECT geo, season, md5('1209' || geo || season) AS digest,
  row_number() OVER (ORDER BY md5('1209' || geo || season), geo, season) AS position
FROM (SELECT DISTINCT geo, season FROM fx_unit)"""))
def _(spark, sf):
    groups = views.units(spark, sf).select("geo", "season").distinct()
    return placed(E.shuffle_units(groups, 1209))


# --- set operations ---

@query("g1_union_all", sql(f"""
SELECT {big('month')} AS month, {rd('surface_dust')} AS surface_dust FROM fx_sample WHERE month IN (8, 1, 7)"""))
def _(spark, sf):
    table = views.samples(spark, sf)
    return G.union_all([prune(by_month(table, m), ["month", "surface_dust"]) for m in (8, 1, 7)])


@query("g2_common_times", sql(f"""
SELECT {ts('time')} AS time, row_number() OVER (ORDER BY time) AS position FROM (
  SELECT time FROM fx_forcing WHERE direct_sw > 0 INTERSECT SELECT time FROM fx_sample WHERE n_layers >= 8)"""))
def _(spark, sf):
    sunny = views.forcing(spark, sf).where("direct_sw > 0")
    deep = views.layers(spark, sf).where("layer = 8")
    return placed(G.common_times(sunny, views.forcing(spark, sf).join(deep, "sample_id", "left_semi")))


@query("g3_overlap", sql("""
SELECT geo, season FROM fx_at WHERE albedo > 0.9 INTERSECT
SELECT geo, season FROM fx_at WHERE month = 8"""))
def _(spark, sf):
    at = views.forcing_at_points(spark, sf)
    bright = at.where("albedo > 0.9").select("geo", "season")
    plan = views.plan(spark, sf)
    G.assert_disjoint(**{
        name: plan.where(F.col("split") == name).select("geo", "season")
        for name in ("train", "test", "val")
    })
    return G.overlap(bright, by_month(at, 8).select("geo", "season"))


@query("g4_input_difference", sql("""
(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "a AS (SELECT geo, season FROM fx_at WHERE albedo > 0.9)",
    "b AS (SELECT geo, season FROM fx_at WHERE month = 8)"))
def _(spark, sf):
    at = views.forcing_at_points(spark, sf)
    bright = at.where("albedo > 0.9").select("geo", "season")
    return G.difference(bright, by_month(at, 8).select("geo", "season"))


@query("g5_drop_unneeded", f"""
SELECT {big('l_orderkey')} AS l_orderkey, {rd('l_tax')} AS l_tax FROM lineitem""")
def _(spark, sf):
    return drop_unneeded(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_tax", "absent"])


# --- split plans ---

_TRAIN = {("ASIA", "1995_1996"), ("EUROPE", "1996_1997")}
_TEST = {("ASIA", "1997_1998")}
_EXPLICIT = """
SELECT DISTINCT geo, season, CASE WHEN season = '1997_1998' THEN 'test' ELSE 'train' END AS split FROM fx_at
WHERE (geo, season) IN (('ASIA', '1995_1996'), ('EUROPE', '1996_1997'), ('ASIA', '1997_1998'))"""


def _seeded(seed: int) -> str:
    return f"""
fx_seeded AS (
  SELECT geo, season, row_number() OVER (ORDER BY md5('{seed}' || geo || season), geo, season) AS place,
    count(*) OVER () AS total FROM fx_group)"""


_COUNTS = """
SELECT geo, season, CASE WHEN place <= 3 THEN 'train' WHEN place <= 4 THEN 'test' ELSE 'val' END AS split
FROM fx_seeded WHERE place <= 5"""
_RATIO = """
SELECT geo, season, CASE WHEN place <= floor(0.7 * total) THEN 'train'
  WHEN place <= floor(0.7 * total) + floor(0.2 * total) THEN 'test' ELSE 'val' END AS split FROM fx_seeded"""


def _stored_units(spark, sf):
    return catalog(stored_units(spark, sf))


@query("h1_split_explicit", sql(_EXPLICIT))
def _(spark, sf):
    return H.split_explicit(_stored_units(spark, sf), _TRAIN, _TEST)


@query("h2_split_counts", sql(_COUNTS, _seeded(1209)))
def _(spark, sf):
    return H.split_counts(_stored_units(spark, sf), 3, 1, 1, seed=1209)


@query("h3_split_ratio", sql(_RATIO, _seeded(1209)))
def _(spark, sf):
    return H.split_ratio(_stored_units(spark, sf), 0.7, 0.2, seed=1209)


@query("h4_train_test_split", sql(f"""
SELECT 'sets' AS kind, * FROM ({_EXPLICIT}) UNION ALL SELECT 'counts', * FROM ({_COUNTS})
UNION ALL SELECT 'ratios', * FROM ({_RATIO})""", _seeded(1209)))
def _(spark, sf):
    known = _stored_units(spark, sf)
    plans = {
        "sets": H.train_test_split(known, _TRAIN, _TEST),
        "counts": H.train_test_split(known, 3, 1, 1, seed=1209),
        "ratios": H.train_test_split(known, 0.7, 0.2, seed=1209),
    }
    return G.union_all([
        p.select(F.lit(kind).alias("kind"), "geo", "season", "split") for kind, p in plans.items()
    ])


_REFRESHED = sql(f"""
SELECT variable, {big('n')} AS n, {rd('mean', 9)} AS mean, {rd('std', 9)} AS std FROM fx_stat""")


# Seasons of the orders lack months, so completeness is not asked for.
@query("h5_refresh_stats", _REFRESHED, digits=9)
def _(spark, sf):
    root, path = stored.samples(spark, sf), scratch_path(spark, "refreshed")
    plan = split_ratio(stored_units(spark, sf), 0.6, 0.2, seed=views.SEED)
    refresh_stored_stats(spark, root, path, plan.where("split = 'train'"), complete=False)
    refresh_stored_stats(spark, root, path, complete=False)
    return load_stats(spark, path)[0]


@query("h5_refresh_any_table", _REFRESHED, digits=9)
def _(spark, sf):
    path = scratch_path(spark, "refreshed")
    labelled = assign_split(stored_samples(spark, sf), views.plan(spark, sf))
    refresh_stats(labelled.where("split = 'train'"), path)
    refresh_stats(labelled, path)
    return load_stats(spark, path)[0]
