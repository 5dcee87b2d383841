"""DuckDB definitions of the views in :mod:`checks.views`."""

from __future__ import annotations

from .views import LAYERS, SEED

L = LAYERS


def rd(expression: str, digits: int = 6) -> str:
    """Rounded double; adding zero turns -0.0 into 0.0."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def ts(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def cos_sza(time: str, lat: str, lon: str, slope: str | None = None, aspect: str | None = None) -> str:
    """The zenith formula as text, term by term."""
    g = f"(2 * pi() * (dayofyear({time}) - 1) / 365.0)"
    dec = (
        f"(CAST(0.006918 AS DOUBLE) - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g})"
        f" + 0.000907 * sin(2 * {g}) - 0.002697 * cos(3 * {g}) + 0.00148 * sin(3 * {g}))"
    )
    eot = (
        f"(CAST(229.18 AS DOUBLE) * (CAST(0.000075 AS DOUBLE) + 0.001868 * cos({g}) - 0.032077 * sin({g})"
        f" - 0.014615 * cos(2 * {g}) - 0.04089 * sin(2 * {g})))"
    )
    omega = f"radians(15 * (hour({time}) + minute({time}) / 60.0 + (4 * {lon} + {eot}) / 60.0 - 12))"
    phi = f"radians({lat})"
    if slope is None:
        return f"(sin({phi}) * sin({dec}) + cos({phi}) * cos({dec}) * cos({omega}))"
    beta, gamma = f"radians({slope})", f"radians({aspect} - 180)"
    return (
        f"(sin({dec}) * sin({phi}) * cos({beta})"
        f" - sin({dec}) * cos({phi}) * sin({beta}) * cos({gamma})"
        f" + cos({dec}) * cos({phi}) * cos({beta}) * cos({omega})"
        f" + cos({dec}) * sin({phi}) * sin({beta}) * cos({gamma}) * cos({omega})"
        f" + cos({dec}) * sin({beta}) * sin({gamma}) * sin({omega}))"
    )


def _lists(*names: str) -> str:
    return ", ".join(f"list_resize(list({n} ORDER BY layer), {L}) AS {n}" for n in names)


EMPTY = f"list_resize(CAST([] AS DOUBLE[]), {L})"

VIEWS = f"""
fx_point AS (
  SELECT c_custkey AS point_id, r_name AS geo, c_nationkey AS massif_number,
    CAST(300 * (c_custkey % 13) AS DOUBLE) AS zs,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(20 * (c_custkey % 3) AS DOUBLE) END AS slope,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(45 * (c_custkey % 8) AS DOUBLE) END AS aspect,
    CAST(42 AS DOUBLE) + CAST(c_custkey % 40 AS DOUBLE) / 10 AS lat,
    CAST(c_custkey % 80 AS DOUBLE) / 10 - CAST(1 AS DOUBLE) AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
fx_forcing AS (
  SELECT o_orderkey AS sample_id, o_orderdate AS time, o_custkey AS point_id,
    CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 1000 END AS direct_sw,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 2000 END AS diffuse_sw,
    o_totalprice / 500000 AS albedo,
    (year(o_orderdate) - CASE WHEN month(o_orderdate) < 8 THEN 1 ELSE 0 END) AS y1,
    CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 8 THEN 1 ELSE 0 END AS VARCHAR) || '_' ||
      CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) < 8 THEN 0 ELSE 1 END AS VARCHAR) AS season,
    month(o_orderdate) AS month,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS patch
  FROM orders),
fx_layer AS (
  SELECT * FROM (
    SELECT l_orderkey AS sample_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_shipdate) AS layer,
      l_quantity / 100 AS dz, l_extendedprice / 1000 AS ssa,
      CAST(50 + 5 * (l_partkey % 100) AS DOUBLE) AS density,
      l_discount + CAST(0 AS DOUBLE) AS conc_soot, l_tax + CAST(0 AS DOUBLE) AS conc_dust
    FROM lineitem)),
fx_profile AS (
  SELECT sample_id, {_lists("dz", "ssa", "density", "conc_soot", "conc_dust")}, sum(dz) AS swe,
    count(*) AS n_layers, least(CAST(1 AS DOUBLE), sum(dz)) AS thickness,
    max(CASE WHEN layer = 1 THEN ssa END) AS surface_ssa,
    max(CASE WHEN layer = 1 THEN density END) AS surface_density,
    max(CASE WHEN layer = 1 THEN conc_dust END) AS surface_dust
  FROM fx_layer GROUP BY sample_id),
fx_at AS (
  SELECT f.*, p.* EXCLUDE (point_id) FROM fx_forcing f JOIN fx_point p USING (point_id)),
fx_sample AS (
  SELECT f.*, {cos_sza("f.time", "f.lat", "f.lon", "f.slope", "f.aspect")} AS cos_sza,
    coalesce(dz, {EMPTY}) AS dz, coalesce(ssa, {EMPTY}) AS ssa, coalesce(density, {EMPTY}) AS density,
    coalesce(conc_soot, {EMPTY}) AS conc_soot, coalesce(conc_dust, {EMPTY}) AS conc_dust,
    swe, coalesce(n_layers, 0) AS n_layers, coalesce(thickness, CAST(0 AS DOUBLE)) AS thickness,
    surface_ssa, surface_density, surface_dust
  FROM fx_at f LEFT JOIN fx_profile q USING (sample_id)),
fx_unit AS (SELECT DISTINCT geo, season, month FROM fx_at),
fx_group AS (
  SELECT geo, season, md5('{SEED}' || geo || season) AS digest FROM (SELECT DISTINCT geo, season FROM fx_at)),
fx_ranked AS (
  SELECT *, row_number() OVER (ORDER BY digest, geo, season) AS place, count(*) OVER () AS total FROM fx_group),
fx_plan AS (
  SELECT geo, season, CASE WHEN place <= floor(CAST(0.6 AS DOUBLE) * total) THEN 'train'
    WHEN place <= floor(CAST(0.6 AS DOUBLE) * total) + floor(CAST(0.2 AS DOUBLE) * total) THEN 'test'
    ELSE 'val' END AS split
  FROM fx_ranked),
fx_pred AS (
  SELECT *, albedo * CAST(0.9 AS DOUBLE) + thickness * CAST(0.05 AS DOUBLE) AS yhat FROM fx_sample),
fx_labelled AS (SELECT * FROM fx_pred JOIN fx_plan USING (geo, season)),
fx_scalar AS (
  SELECT l.geo, l.season, l.split, v.variable, v.x FROM fx_labelled l,
    LATERAL (VALUES ('direct_sw', l.direct_sw), ('diffuse_sw', l.diffuse_sw), ('cos_sza', l.cos_sza),
      ('albedo', l.albedo)) AS v(variable, x)),
fx_value AS (
  SELECT geo, season, split, variable, x FROM (
    SELECT sample_id, v.variable, v.x FROM fx_layer y,
      LATERAL (VALUES ('dz', y.dz), ('ssa', y.ssa), ('density', y.density), ('conc_soot', y.conc_soot),
        ('conc_dust', y.conc_dust)) AS v(variable, x))
    JOIN (SELECT sample_id, geo, season FROM fx_at) USING (sample_id)
    JOIN fx_plan USING (geo, season)
  UNION ALL SELECT geo, season, split, variable, x FROM fx_scalar),
fx_stat AS (
  SELECT variable, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM fx_value GROUP BY variable),
fx_train AS (
  SELECT variable, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM fx_value
  WHERE split = 'train' GROUP BY variable),
fx_norm AS (
  SELECT {", ".join(
    f"max(CASE WHEN variable = '{v}' THEN {k} END) AS {v}_{k}"
    for v in ("dz", "ssa", "density", "conc_soot", "conc_dust", "direct_sw", "diffuse_sw", "cos_sza", "albedo")
    for k in ("mean", "std"))} FROM fx_train),
fx_hourly AS (
  SELECT user_id, date_trunc('hour', ts) AS time, avg(value) AS value FROM events GROUP BY ALL),
fx_daily AS (
  SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, avg(value) AS value FROM events GROUP BY ALL),
fx_flux AS (
  SELECT event_id, user_id AS point_id, ts AS time,
    CASE WHEN event_type = 'click' THEN value ELSE 0 END AS imp_dry1,
    CASE WHEN event_type = 'view' THEN value ELSE 0 END AS imp_wet1,
    CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS imp_dry2,
    CASE WHEN event_type = 'error' THEN value ELSE 0 END AS imp_wet2
  FROM events),
fx_log AS (
  SELECT epoch, CAST(0.0001 AS DOUBLE) * pow(CAST(0.99 AS DOUBLE), epoch - 1) AS learning_rate,
    train_loss, train_metric, test_loss, test_metric FROM (
    SELECT CAST(dayofyear(ts) AS BIGINT) AS epoch,
      coalesce(avg(CASE WHEN event_type = 'click' THEN value END), 0) AS train_loss,
      coalesce(avg(CASE WHEN event_type = 'view' THEN value END), 0) AS train_metric,
      coalesce(avg(CASE WHEN event_type = 'purchase' THEN value END), 0) AS test_loss,
      coalesce(avg(CASE WHEN event_type = 'error' THEN value END), 0) AS test_metric
    FROM events GROUP BY 1))
"""


def sql(body: str, *more: str) -> str:
    """A query over the views; ``more`` are further common table expressions."""
    ctes = ",\n".join([VIEWS.strip(), *[m.strip() for m in more]])
    return f"WITH {ctes}\n{body.strip()}"
