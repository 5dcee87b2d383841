"""The ledger of a stored table: which units it has, and what is known of each.

A write fills a folder of its own, ``data/commit=<id>``, and becomes visible by
one file appended to ``_ledger``: a row per unit with its number of rows, a
digest of its content, time range, depth, value ranges and moments, all taken
from the files just written.  Nothing stored is ever changed, so a reader keeps
the commits it started with, a writer that fails leaves nothing visible, and two
writers on different seasons never meet.  What is current follows from the rows
alone: the latest commit of a scope, which is a season for samples and a unit
for tables derived unit by unit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layers import depth
from ..operators.stats import layer_rows, moment_columns, moment_entries
from ..schema import GROUP_COLS, LAYER_VARS, SAMPLE_SCHEMA, STAT_VARS, SUN_VARS, TARGET, UNIT_COLS

#: Spark passes over names with an underscore when it reads the table itself.
LEDGER, DATA = "_ledger", "data"

UNIT_SCHEMA = T.StructType([f for f in SAMPLE_SCHEMA.fields if f.name in UNIT_COLS])
LEDGER_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("commit", T.StringType()),
    *UNIT_SCHEMA.fields,
    T.StructField("n", T.LongType()),
    T.StructField("digest", T.StringType()),
    T.StructField("recipe", T.StringType()),
    T.StructField("start", T.TimestampNTZType()),
    T.StructField("end", T.TimestampNTZType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("ranges", T.MapType(T.StringType(), T.StructType([
        T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
    ]))),
    T.StructField("moments", T.ArrayType(T.StructType([
        T.StructField("variable", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType()),
    ]))),
])

# What Spark writes as %XX in the name of a partition folder.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def content(df: DataFrame) -> Column:
    """Hash of a row that changes with any of its values."""
    return F.xxhash64(*[F.col(c) for c in sorted(df.columns)])


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every row ever appended, current or not."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(f"{root}/{LEDGER}")
    except AnalysisException as error:
        raise FileNotFoundError(f"nothing stored at {root}") from error


def has_ledger(spark: SparkSession, root: str) -> bool:
    try:
        ledger(spark, root)
    except FileNotFoundError:
        return False
    return True


def _latest(scope: Sequence[str]) -> Column:
    """Whether a ledger row belongs to its scope's latest commit."""
    at = F.struct("version", "commit")
    return at == F.max(at).over(W.partitionBy(*scope))


def current(rows: DataFrame, scope: Sequence[str] = GROUP_COLS) -> DataFrame:
    """The rows of each scope's latest commit; a row without ``n`` marks a removal."""
    return rows.withColumn("_latest", _latest(scope)).where(F.col("_latest") & F.col("n").isNotNull()).drop("_latest")


def units(spark: SparkSession, root: str, scope: Sequence[str] = GROUP_COLS) -> DataFrame:
    """One row per stored unit, from the ledger alone: no file of the table is opened."""
    return current(ledger(spark, root), scope)


def unit_sizes(stored: DataFrame) -> DataFrame:
    """Rows per unit, from :func:`units`."""
    return stored.select(*UNIT_COLS, "n")


def coverage(stored: DataFrame, by: Sequence[str] = tuple(UNIT_COLS)) -> DataFrame:
    """First and last time, from :func:`units`."""
    return stored.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def stored_range(stored: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value of a column over whole units, from :func:`units`."""
    held = F.col("ranges")[column]
    return stored.groupBy(*by).agg(F.min(held["low"]).alias("low"), F.max(held["high"]).alias("high"))


def stored_spans(stored: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The range of each column, for a histogram over whole units; columns without values are left out."""
    ends = stored.agg(*[
        F.struct(F.min(F.col("ranges")[c]["low"]).alias("low"), F.max(F.col("ranges")[c]["high"]).alias("high")).alias(c)
        for c in columns
    ]).first()
    return {c: (ends[c]["low"], ends[c]["high"]) for c in columns if ends[c]["low"] is not None}


def stored_moments(stored: DataFrame) -> DataFrame:
    """Partial moments per unit and variable, as :func:`layerframe.operators.stats.merge_stats` takes them."""
    return stored.select(*UNIT_COLS, F.inline("moments"))


def deepest(stored: DataFrame) -> int:
    """Layers of the deepest profile stored."""
    return stored.agg(F.max("depth").alias("depth")).first()["depth"] or 0


def summarise(df: DataFrame) -> DataFrame:
    """The ledger's knowledge of each unit of ``df``, in one scan and one shuffle.

    Layers are opened once for the moments; everything counted per sample is
    taken on its first layer.  Of a table without profiles, only what its
    columns allow is known.
    """
    profiles = all(c in df.columns for c in (*LAYER_VARS, *SUN_VARS, TARGET))
    marked = df.withColumn("_row", content(df).cast("decimal(38,0)"))
    numbers = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in UNIT_COLS
        and not (profiles and f.name in STAT_VARS)
    ]
    also = [c for c in ("time",) if c in df.columns]
    if profiles:
        marked = marked.withColumn("_depth", depth(*LAYER_VARS))
        rows = layer_rows(marked, UNIT_COLS, ["_row", "_depth", *also, *numbers])
        ranged = [*numbers, *STAT_VARS]
        moments, deep = moment_columns(), F.max("_depth")
    else:
        rows = marked.select(*UNIT_COLS, "_row", *also, *numbers, F.lit(0).alias("at"))
        ranged, moments, deep = numbers, [F.count_if(F.col("at") == 0).alias("n_rows")], F.lit(None).cast("int")
    times = (F.min("time"), F.max("time")) if also else (F.lit(None).cast("timestamp_ntz"),) * 2
    grouped = rows.groupBy(*UNIT_COLS).agg(
        *moments,
        F.sum(F.when(F.col("at") == 0, F.col("_row"))).cast("string").alias("digest"),
        times[0].cast("timestamp_ntz").alias("start"),
        times[1].cast("timestamp_ntz").alias("end"),
        deep.alias("depth"),
        *[F.min(c).cast("double").alias(f"_low_{c}") for c in ranged],
        *[F.max(c).cast("double").alias(f"_high_{c}") for c in ranged],
    )
    entries = [
        F.struct(F.lit(c).alias("key"), F.struct(F.col(f"_low_{c}").alias("low"), F.col(f"_high_{c}").alias("high")).alias("value"))
        for c in ranged
    ]
    return grouped.select(
        *UNIT_COLS,
        F.col("n_rows").alias("n"),
        "digest",
        F.lit(None).cast("string").alias("recipe"),
        "start",
        "end",
        "depth",
        (F.map_from_entries(F.array(*entries)) if entries else F.lit(None)).alias("ranges"),
        (moment_entries() if profiles else F.lit(None)).alias("moments"),
    )


def next_version(spark: SparkSession, root: str) -> int:
    """One above every version in the ledger; two writers may share one, their commits then decide."""
    if not has_ledger(spark, root):
        return 1
    return (ledger(spark, root).agg(F.max("version").alias("v")).first()["v"] or 0) + 1


def new_commit() -> str:
    return uuid.uuid4().hex


def commit_folder(root: str, commit: str) -> str:
    return f"{root}/{DATA}/commit={commit}"


def append(rows: DataFrame, root: str, version: int, commit: str) -> None:
    """Make a commit visible: one task writes one file, so its units appear together."""
    full = rows.withColumns({"version": F.lit(version).cast("long"), "commit": F.lit(commit)})
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields]
    full.select(*fields).coalesce(1).write.mode("append").parquet(f"{root}/{LEDGER}")


def _folder(value: object) -> str:
    if value is None or value == "":
        return NULL_FOLDER
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 else c for c in str(value))


def folders(root: str, rows: Iterable, scope: Sequence[str]) -> list[str]:
    """The folder of each (commit, scope) row."""
    return [
        "/".join([commit_folder(root, r["commit"]), *[f"{c}={_folder(r[c])}" for c in scope]]) for r in rows
    ]


def current_folders(spark: SparkSession, root: str, scope: Sequence[str]) -> list[str]:
    """A commit's own folder where all it wrote is current, else those of its current scopes."""
    marked = ledger(spark, root).withColumn("_latest", _latest(scope))
    rows = marked.where("n IS NOT NULL").select("commit", *scope, "_latest").distinct().collect()
    partly = {r["commit"] for r in rows if not r["_latest"]}
    whole = sorted({r["commit"] for r in rows} - partly)
    return [commit_folder(root, c) for c in whole] + folders(root, [r for r in rows if r["_latest"] and r["commit"] in partly], scope)


def read_current(
    spark: SparkSession, root: str, schema: T.StructType, chosen: DataFrame | None = None, scope: Sequence[str] = GROUP_COLS
) -> DataFrame:
    """The current files, or those of the units ``chosen``, as one table.

    Only their folders are listed: one row per season (or unit) reaches the
    driver, as many as the catalog has.
    """
    if chosen is None:
        paths = current_folders(spark, root, scope)
    else:
        paths = folders(root, chosen.select("commit", *scope).distinct().collect(), scope)
    if not paths:
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).option("basePath", f"{root}/{DATA}").parquet(*paths)
    return table.select(*schema.names)


def forget(spark: SparkSession, root: str, scope: Sequence[str] = GROUP_COLS) -> int:
    """Empty the folders of commits that nothing current refers to; how many there were.

    Commits not in the ledger, as those being written, are left alone.  Readers
    that started before lose their files, so call it when there are none.
    """
    rows = ledger(spark, root)
    held = units(spark, root, scope).select("commit").distinct()
    dead = [r["commit"] for r in rows.select("commit").distinct().join(held, "commit", "left_anti").collect()]
    for commit in dead:
        spark.createDataFrame([], UNIT_SCHEMA).write.mode("overwrite").parquet(commit_folder(root, commit))
    return len(dead)
