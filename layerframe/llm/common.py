"""Small helpers the text operators share."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerframe.session import scratch_path

#: Characters that separate words in every word-based operator.
SEPARATORS = "\x20\x09-\x0d"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The table survives the loss of any executor, and what reads it neither
    repeats the work nor carries its lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns under names of our own; a null text is the empty one."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")
