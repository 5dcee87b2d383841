"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}

_local_root: str | None = None
_scopes: list[list[str]] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the library is tuned for to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Let joins on more columns than the buckets use read the buckets as they are.

    For plans over bucketed inputs only, executed inside the block: elsewhere a
    join on part of its keys could lose its spread.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where driver and executors are one process, as in tests, may it be a
    folder of this machine; anywhere else an unset folder is an error.
    """
    global _local_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="layerframe-")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that nothing has used yet."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Empty, at the end of the block, every scratch table that was written inside it.

    For work whose results have been stored elsewhere or collected by then.
    Yields the list of paths; one taken off it is kept.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.pop()
        for path in paths:
            spark.createDataFrame([], "nothing int").write.mode("overwrite").parquet(path)


#: Partitions into which each scanned one is dealt where rows are sorted by key.
PIECES = 8


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A scanned table, its rows dealt by key into partitions that do not grow with it.

    With a fixed number of shuffle partitions each holds more rows the larger the
    table is, until the sort of one no longer fits in memory; adaptive execution
    joins small partitions, but splits none that a window or a join reads by key.
    """
    spark = df.sparkSession
    pieces = PIECES * df.rdd.getNumPartitions()
    if pieces <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(pieces, *keys)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df`` through a Parquet table in the scratch folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
