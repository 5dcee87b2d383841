"""Registered queries and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerframe.operators.ordering import ROW_BITS
from layerframe.session import materialise

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register a query; its result is brought into comparable form by :func:`tidy`."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return tidy(fn(spark, sf), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def placed(df: DataFrame) -> DataFrame:
    """Adds the position of each row in the order ``df`` has: wrong once its sort is gone.

    The sorted rows are written once; one count per partition gives the rest.
    """
    numbered = materialise(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", ROW_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return numbered.withColumn("_part", part).join(starts, "_part").withColumn(
        "position", F.col("_start") + inside + 1
    ).drop("_at", "_part", "_start")


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Long integers, rounded doubles, times as text, flags as 0/1."""
    def plain(field: T.StructField) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.BooleanType):
            c = c.cast("int").cast("long")
        elif isinstance(kind, T.DecimalType):
            c = F.round(c.cast("double"), digits)
        elif isinstance(kind, T.IntegralType):
            c = c.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])
