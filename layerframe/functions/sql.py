"""The library's vocabulary in SQL text: temporary functions, all of them run in the JVM.

``register(spark)`` makes them known to the session's SQL.  Scalar functions
work on a row's own columns; table functions turn one row into several and are
called behind ``LATERAL``.

    SELECT user_id, g.time FROM (SELECT user_id, time, lead(time) OVER (PARTITION BY user_id ORDER BY time) AS next FROM s),
      LATERAL gaps(time, next, INTERVAL '1' HOUR) AS g
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .layers import MAX_DEPTH

#: name and arguments, what comes back, and the SQL that says how
FUNCTIONS = [
    (
        "layer_sum(layers ARRAY<DOUBLE>)", "DOUBLE",
        "coalesce(aggregate(layers, 0D, (total, x) -> total + coalesce(x, 0D)), 0D)",
    ),
    (
        "layer_count(layers ARRAY<DOUBLE>)", "INT",
        "coalesce(size(filter(layers, x -> x IS NOT NULL)), 0)",
    ),
    (
        "thickness(dz ARRAY<DOUBLE>)", "DOUBLE",
        f"least({MAX_DEPTH}D, coalesce(aggregate(dz, 0D, (total, x) -> total + coalesce(x, 0D)), 0D))",
    ),
    (
        "season_of(at TIMESTAMP_NTZ)", "STRING",
        "CAST(year(at) - if(month(at) < 8, 1, 0) AS STRING) || '_' || CAST(year(at) + if(month(at) < 8, 0, 1) AS STRING)",
    ),
    ("month_start(at TIMESTAMP_NTZ)", "TIMESTAMP_NTZ", "CAST(date_trunc('MONTH', at) AS TIMESTAMP_NTZ)"),
    (
        # the last bin takes its right edge as well; what lies outside has no bin
        "histogram_bin(x DOUBLE, low DOUBLE, high DOUBLE, bins INT)", "BIGINT",
        "CASE WHEN x >= low AND x < high THEN least(bins - 1, floor((x - low) / (high - low) * bins)"
        " - CASE WHEN x < low + floor((x - low) / (high - low) * bins) * ((high - low) / bins) THEN 1 ELSE 0 END"
        " + CASE WHEN x >= low + (floor((x - low) / (high - low) * bins) + 1) * ((high - low) / bins) THEN 1 ELSE 0 END)"
        " WHEN x = high THEN bins - 1 END",
    ),
    (
        "gaps(since TIMESTAMP_NTZ, until TIMESTAMP_NTZ, step INTERVAL DAY TO SECOND)", "TABLE(time TIMESTAMP_NTZ)",
        "SELECT explode(if(since + step < until, sequence(since + step, until - INTERVAL '0.000001' SECOND, step), array()))",
    ),
    (
        "month_starts(since TIMESTAMP_NTZ, until TIMESTAMP_NTZ)", "TABLE(month TIMESTAMP_NTZ)",
        "SELECT explode(sequence(CAST(date_trunc('MONTH', since) AS TIMESTAMP_NTZ), CAST(date_trunc('MONTH', until) AS TIMESTAMP_NTZ),"
        " INTERVAL '1' MONTH))",
    ),
    (
        "histogram_bins(low DOUBLE, high DOUBLE, bins INT)", "TABLE(bin BIGINT, low_edge DOUBLE, high_edge DOUBLE)",
        "SELECT k, low + k * ((high - low) / bins), if(k = bins - 1, high, low + (k + 1) * ((high - low) / bins))"
        " FROM (SELECT explode(sequence(0L, bins - 1L)) AS k)",
    ),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``; calling it again replaces them."""
    for head, kind, body in FUNCTIONS:
        returned = body if kind.startswith("TABLE") else f"({body})"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {returned}")
