"""Training corpus from documents: language, repeated lines, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerframe.llm import bpe, language, line_dedup, mixing, near_dedup
from layerframe.llm.common import store
from layerframe.llm.queries import tokenizer_path

#: Least calibrated share of the predicted language.
SURE = 0.5
#: Words of a shingle.
WORDS = 5


#: Columns that line_dedup adds; a table's own of these names are set aside meanwhile.
LINE_COUNTS = ("n_lines", "n_chunks", "removed_lines", "removed_chunks")


def free_prefix(docs: DataFrame) -> str:
    """Underscores that no column of ``docs`` begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language the model is sure of; fills in a null lang.

    Null and empty texts, and texts without a letter, have no language and go.
    Repeated rows and null ids are judged each by its own text; long texts are
    read whole; other columns pass through.
    """
    return language.keep_identified(docs, language.train(docs), SURE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; drops documents of which nothing is left.

    Null and empty texts have no passage and stay as they are; of repeated rows
    the first keeps its passages; other columns pass through, whatever their names.
    """
    own = free_prefix(docs)
    aside = {c: f"{own}{c}" for c in LINE_COUNTS if c in docs.columns}
    cut = line_dedup.remove_repeated_chunks(docs.withColumnsRenamed(aside))
    left = cut.filter((F.col("removed_chunks") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    left = left.drop(*LINE_COUNTS).withColumnsRenamed({held: c for c, held in aside.items()})
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the smallest id.

    Rows are told apart by a number of their own, so repeated ids, repeated rows
    and null ids are compared by their texts like any others; a null id stays
    only where its group has no other.  Texts without words are in no group and
    stay.  Other columns pass through, whatever their names.
    """
    own = free_prefix(docs)
    row, group = f"{own}row", f"{own}group"
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "corpus-rows")
    groups = near_dedup.near_duplicates(numbered, id_col=row, words=WORDS).select(
        F.col("doc_id").alias(row), F.col("component_id").alias(group)
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(row).alias("row")))
    kept = numbered.select(row, "doc_id").join(groups, row).groupBy(group).agg(first.alias("first"))
    return numbered.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it, to the nearest whole reading.

    A reading counts if it takes half of the document's words or more, so a
    source's words come within one document of what the mix takes.  Documents
    without words are never read and go; a null source is a source; rows that
    repeat id, source and size share their readings.  Other columns pass
    through, whatever their names.
    """
    own = free_prefix(docs)
    documents, _ = mixing.mix(docs)
    readings = (
        documents.groupBy("doc_id", "source", "size")
        .agg(F.try_divide(F.sum("taken"), F.first("size") * F.count("*")).alias("share"))
        .select(*[F.col(c).alias(own + c) for c in ("doc_id", "source", "size")], F.floor(F.col("share") + 0.5).cast("int").alias(f"{own}n"))
        .filter(F.col(f"{own}n") > 0)
    ).withColumn(f"{own}reading", F.explode(F.sequence(F.lit(1), F.col(f"{own}n"))))
    met = (
        F.col("doc_id").eqNullSafe(F.col(f"{own}doc_id"))
        & F.col("source").eqNullSafe(F.col(f"{own}source"))
        & (mixing.word_count(F.col("text")) == F.col(f"{own}size"))
    )
    return docs.join(readings, met).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (four little-endian bytes each), and the text they decode to.

    A null text counts as empty; a null id stays null; repeated rows give repeated rows.
    """
    coded = bpe.encode_texts(docs, bpe.read_model(tokenizer_path()))
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text")
    )


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language, near duplicates and tokens have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
