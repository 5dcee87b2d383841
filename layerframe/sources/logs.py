"""Training logs as CSV, in the three shapes they are found in."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG_CURRENT, LOG_SHAPES, LOG_SHORT
from ..operators.sets import union_all

# Loss and metric swap meaning between scripts, so rows of different shape must
# not be compared: every row carries the shape it came in.
SHAPE = "log_shape"


def append_log(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Add epochs to a log; a fresh run starts the log over."""
    mode = "overwrite" if fresh else "append"
    df.repartition(1).write.mode(mode).option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log in whichever shape its header announces, over the widest schema.

    Every file of a folder must have that header: another one, or the same
    columns in another order, is an error and never read by position.
    """
    header = spark.read.option("header", True).csv(path).columns
    for name, schema in LOG_SHAPES.items():
        if header == schema.names:
            reader = spark.read.option("header", True).option("enforceSchema", False)
            rows = reader.schema(schema).csv(path)
            return _widen(rows, name)
    raise ValueError(f"unknown log header {header}")


def _widen(rows: DataFrame, shape: str) -> DataFrame:
    every = [*LOG_CURRENT.fields, *[f for f in LOG_SHORT.fields if f.name != "epoch"]]
    columns = [
        F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in every
    ]
    return rows.select(*columns, F.lit(shape).alias(SHAPE))


def read_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return union_all([read_log(spark, p) for p in paths])


def read_log_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every log below a folder in one read, each file in the shape of its own header.

    A file is one row until its header has told its shape, so files of different
    shapes may lie side by side, and a large folder is one job however many logs
    it holds.  ``log`` is the file's path below ``folder``; an unknown header is
    an error, an empty file has no rows.
    """
    files = (
        spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
        .select(F.split(F.rtrim("value"), r"\r?\n").alias("lines"), F.col("_metadata.file_path").alias("path"))
        .where(F.col("lines")[0] != "")
    )
    header = F.trim(F.col("lines")[0])
    shape = F.raise_error(F.concat(F.lit("unknown log header "), header)).cast("string")
    for name, schema in LOG_SHAPES.items():
        shape = F.when(header == ",".join(schema.names), name).otherwise(shape)
    below = F.element_at(F.split("path", _last_part(folder)), -1)
    rows = files.select(
        shape.alias(SHAPE), below.alias("log"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")
    ).where(F.trim("line") != "")
    parts = rows.withColumn("parts", F.split("line", ","))

    def value(field) -> object:
        at = [(name, schema.names.index(field.name)) for name, schema in LOG_SHAPES.items() if field.name in schema.names]
        out = F.lit(None).cast("string")
        for name, place in at:
            out = F.when(F.col(SHAPE) == name, F.get("parts", F.lit(place))).otherwise(out)
        return F.when(F.trim(out) != "", out).cast(field.dataType).alias(field.name)

    every = [*LOG_CURRENT.fields, *[f for f in LOG_SHORT.fields if f.name != "epoch"]]
    return parts.select(*[value(f) for f in every], SHAPE, "log")


def _last_part(folder: str) -> str:
    """A pattern for the folder's own name in the paths below it, which are percent-encoded."""
    name = quote(folder.rstrip("/").rpartition("/")[2], safe="=+$,;@&!~*'()")
    return f"/{re.escape(name)}/"
