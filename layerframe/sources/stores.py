"""Persisted statistics and feature tables that know what they were built from."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import require_complete
from ..operators.features import build_features
from ..operators.sets import same_inputs
from ..operators.stats import Norm, finish_stats, merge_stats, partial_stats
from ..schema import DEFAULT_LAYERS, GROUP_COLS, SAMPLE_SCHEMA, UNIT_COLS
from ..session import materialise
from . import ledger


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def save_stats(stats: DataFrame, inputs: DataFrame, path: str) -> None:
    """Store the statistics with the groups they cover and the date of the fit.

    The list of groups is emptied first and written last, so statistics of an
    interrupted run are never taken for those of an earlier selection.
    """
    dated = inputs.withColumn("fitted_at", F.current_timestamp().cast("timestamp_ntz"))
    dated.limit(0).write.mode("overwrite").parquet(f"{path}/inputs")
    stats.repartition(1).write.mode("overwrite").parquet(f"{path}/stats")
    dated.repartition(1).write.mode("overwrite").parquet(f"{path}/inputs")


def load_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored statistics and the groups they were fitted on."""
    return spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/inputs")


def group_sizes(df: DataFrame) -> DataFrame:
    """Rows and content of each (geo, season): what a statistics table is fitted on.

    The content is the sum of one hash per row, so it follows every value but
    neither the order of the rows nor the files they are in.
    """
    return df.groupBy(*GROUP_COLS).agg(
        F.count(F.lit(1)).alias("n_rows"), content(df).alias("content")
    )


def content(df: DataFrame) -> Column:
    """Aggregate that changes with any value of ``df``, whatever the order of rows."""
    return F.sum(ledger.content(df).cast("decimal(38,0)")).cast("string")


def stored_group_sizes(stored: DataFrame) -> DataFrame:
    """:func:`group_sizes` of whole units, from the ledger."""
    return stored.groupBy(*GROUP_COLS).agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("content")
    )


def refresh_stored_stats(
    spark: SparkSession, root: str, path: str, plan: DataFrame | None = None, complete: bool = True
) -> bool:
    """Statistics of a stored table, from the moments its writers left in the ledger.

    ``plan`` limits them to its (geo, season) groups.  Nothing is computed when
    the same content was fitted before; otherwise the chosen units' moments are
    merged.  No sample is read either way.  A season without its twelve months
    is an error unless ``complete`` is off.  Returns whether anything was stored.
    """
    stored = ledger.units(spark, root)
    if plan is not None:
        stored = stored.join(plan.select(*GROUP_COLS).distinct(), GROUP_COLS, "left_semi")
    if complete:
        require_complete(stored)
    groups = materialise(stored_group_sizes(stored), "groups")
    inputs = _read(spark, f"{path}/inputs")
    if inputs is not None and set(groups.columns) <= set(inputs.columns) and same_inputs(groups, inputs):
        return False
    save_stats(finish_stats(merge_stats(ledger.stored_moments(stored))), groups, path)
    return True


def refresh_stats(df: DataFrame, path: str) -> bool:
    """Refit only when nothing is stored or some group changed.

    Partial moments are kept per (geo, season): only groups that are new, or
    whose rows changed in number or content, are fitted; everything else is
    merged from what is stored.  Returns whether anything was computed.
    """
    spark = df.sparkSession
    groups = materialise(group_sizes(df), "groups")
    inputs = _read(spark, f"{path}/inputs")
    if inputs is not None and not set(groups.columns) <= set(inputs.columns):
        inputs = None  # stored before contents were kept
    if inputs is not None and same_inputs(groups, inputs):
        return False
    stored = _read(spark, f"{path}/partials")
    wanted = groups
    if stored is not None and inputs is not None:
        known = inputs.select(*groups.columns).distinct()
        fitted = stored.select(*GROUP_COLS).distinct()
        unchanged = groups.join(known, groups.columns, "left_semi").join(fitted, GROUP_COLS, "left_semi")
        wanted = materialise(groups.join(unchanged, GROUP_COLS, "left_anti"), "changed-groups")
    fresh = df.join(wanted.select(*GROUP_COLS), GROUP_COLS, "left_semi")
    (
        partial_stats(fresh, GROUP_COLS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*GROUP_COLS)
        .parquet(f"{path}/partials")
    )
    partials = spark.read.parquet(f"{path}/partials").join(
        groups.select(*GROUP_COLS), GROUP_COLS, "left_semi"
    )
    save_stats(finish_stats(merge_stats(partials)), groups, path)
    return True


def feature_fingerprint(
    df: DataFrame, norm: Norm, layers: int, keys: tuple[str, ...] = ("time", "point_id")
) -> str:
    """Identity of a feature table: its rows, the norm, the depth, the key columns.

    Statistics count to nine digits: the last ones depend on the order of tasks.
    """
    state = df.agg(F.count(F.lit(1)).alias("n"), content(df).alias("content")).first()
    nine = lambda values: {k: v if v is None else f"{v:.8e}" for k, v in values.items()}
    return json.dumps(
        {
            "content": state["content"],
            "n": state["n"],
            "layers": layers,
            "keys": list(keys),
            "mean": nine(norm.mean),
            "std": nine(norm.std),
        },
        sort_keys=True,
    )


def cached_features(
    df: DataFrame,
    norm: Norm,
    path: str,
    keys: tuple[str, ...] = ("time", "point_id"),
    layers: int = DEFAULT_LAYERS,
    force_rebuild: bool = False,
) -> DataFrame:
    """Feature table, rebuilt when it is missing, forced, or built from something else."""
    spark = df.sparkSession
    wanted = feature_fingerprint(df, norm, layers, keys)
    built = _read(spark, f"{path}/fingerprint")
    valid = built is not None and built.where(F.col("fingerprint") == wanted).count() == 1
    if force_rebuild or not valid:
        # The mark is emptied first: a half-written table must not look valid.
        mark = spark.createDataFrame([(wanted,)], "fingerprint string")
        mark.limit(0).write.mode("overwrite").parquet(f"{path}/fingerprint")
        build_features(df, norm, keys, layers).write.mode("overwrite").parquet(f"{path}/features")
        mark.write.mode("overwrite").parquet(f"{path}/fingerprint")
    return spark.read.parquet(f"{path}/features")


def recipe_of(norm: Norm, layers: int, keys: tuple[str, ...]) -> str:
    """What a feature row depends on besides its sample; statistics count to nine digits."""
    nine = lambda values: {k: v if v is None else f"{v:.8e}" for k, v in values.items()}
    return json.dumps({"layers": layers, "keys": list(keys), "mean": nine(norm.mean), "std": nine(norm.std)}, sort_keys=True)


def refresh_features(
    spark: SparkSession,
    root: str,
    path: str,
    norm: Norm,
    keys: tuple[str, ...] = ("time", "point_id"),
    layers: int = DEFAULT_LAYERS,
    schema: T.StructType = SAMPLE_SCHEMA,
) -> int:
    """Bring a feature table up to date with the stored samples, unit by unit.

    The table's own ledger names, per unit, the content and the recipe it was
    built from.  Units that are new, whose content changed, or that another
    recipe built, are built from their own folders and nothing else is read;
    units no longer stored are marked as removed.  A unit rewritten with equal
    content is left alone.  Returns the number of units built.
    """
    recipe = recipe_of(norm, layers, keys)
    stored = ledger.units(spark, root)
    wanted = stored.select(*UNIT_COLS, "n", "digest", F.lit(recipe).alias("recipe"), "commit")
    same = [*UNIT_COLS, "digest", "recipe"]
    if ledger.has_ledger(spark, path):
        built = ledger.units(spark, path, UNIT_COLS).select(*same)
    else:
        built = spark.createDataFrame([], wanted.select(*same).schema)
    # one row per unit: as many as the catalog has
    changed = materialise(wanted.join(built, same, "left_anti"), "changed-units")
    gone = built.select(*UNIT_COLS).distinct().join(stored.select(*UNIT_COLS), UNIT_COLS, "left_anti")
    number = changed.count()
    removed = materialise(gone, "removed-units")
    if not number and not removed.count():
        return 0
    commit, version = ledger.new_commit(), ledger.next_version(spark, path)
    if number:
        samples = ledger.read_current(spark, root, schema, changed, UNIT_COLS)
        kept = tuple(dict.fromkeys((*keys, *UNIT_COLS)))
        # The samples' files are sized and split by unit, so features are written as they are read: nothing
        # is shuffled, and the sort by unit that the writer needs sees profiles, not padded vectors.
        features = build_features(samples.sortWithinPartitions(*UNIT_COLS), norm, kept, layers)
        features.write.partitionBy(*UNIT_COLS).parquet(ledger.commit_folder(path, commit))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in ledger.LEDGER_SCHEMA.fields}
    rows = changed.drop("commit").unionByName(removed, allowMissingColumns=True)
    ledger.append(rows.withColumns({c: v for c, v in blank.items() if c not in rows.columns}), path, version, commit)
    return number


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The feature table of ``schema`` (keys, ``x_snow``, ``x_sun``, ``y`` and the unit) as it is current."""
    return ledger.read_current(spark, path, schema, scope=UNIT_COLS)


def feature_schema(keys: tuple[str, ...], schema: T.StructType = SAMPLE_SCHEMA) -> T.StructType:
    """Columns of a feature table with these keys."""
    floats = T.ArrayType(T.FloatType())
    named = [schema[k] for k in dict.fromkeys((*keys, *UNIT_COLS))]
    return T.StructType([
        *named,
        T.StructField("x_snow", T.ArrayType(floats)), T.StructField("x_sun", floats), T.StructField("y", T.FloatType()),
    ])
