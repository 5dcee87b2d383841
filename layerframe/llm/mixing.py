"""Mixing sources to target weights by a low-discrepancy schedule.

Sources share a budget of words by weight, none above a multiple of its own
size (the excess is shared again by weight).  Golden-ratio points, mapped
through the cumulative targets, decide which source each slot of the mix takes;
slots are ranked per source.  Each source's documents, shuffled by a seeded
digest, form a stream that may be read several times over; the part the mix
takes is cut into as many equal blocks as the source has slots, and the r-th
slot reads the r-th block.

Ranks and stream positions are running sums in two levels: per cell of a fixed
partition of the slots or digests first, then inside each cell.  No source is
ever in one task, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerframe.llm.common import store

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words, in hundredths.
SHARE = 150
#: Times a document may be read.
MOST_READS = 2
#: Words of a block, about.
BLOCK = 1024
#: Golden-ratio step on a circle of 2**31 points.
STEP, CIRCLE = 1327217885, 1 << 31
#: Cells of the circle, to find a point's source by an equi-join.
CELLS = 1024
#: Cells of the shuffled order of a source.
SHUFFLE_CELLS = 1024
#: Slots per cell of the schedule.
SLOT_CELL = 4096

#: What separates words, as Java writes it.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most_reads: int = MOST_READS
) -> DataFrame:
    """(source, words) -> the same with rank, weight, the double ``target``, and its cap.

    Sources fill up in the order of cap by weight; once those below have been
    cut off at their caps, the rest is shared by weight.  One row per source:
    its windows run over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    # ties in cap by weight give the same level, so any order of them will do
    filling = Window.orderBy("fill", "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    behind = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("fill", "rank")
    return (
        ranked.withColumn("weight", F.get(table, (F.col("rank") % len(weights)).cast("int")))
        .withColumn("cap", F.col("words").cast("double") * most_reads)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("words").over(everything) * F.lit(share) / F.lit(100.0))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.sum("weight").over(behind))
        # the first source that its level does not fill sets the level for all behind it
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("source", "rank", "words", "weight", "target", F.floor("target").cast("long").alias("take"))
    )


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rank, turn, slot): which source each slot of the mix reads, ranked per source.

    Slots are numbered from 0; the point of slot i is i golden-ratio steps along
    the circle.  A source too small to be met by any point gets one slot at the end.
    """
    spark = targets.sparkSession
    total = F.sum("take").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("rank"))
    upto = F.sum("take").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    arcs = (
        targets.filter("take > 0")
        .withColumn("total", total)
        .withColumn("upto", upto)
        .select(
            "rank",
            "total",
            F.floor((F.col("upto") - F.col("take")) / F.col("total") * CIRCLE).cast("long").alias("first"),
            F.floor(F.col("upto") / F.col("total") * CIRCLE).cast("long").alias("last"),
        )
    )
    width = CIRCLE // CELLS
    by_cell = arcs.filter("last > first").withColumn(
        "cell", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(last - 1) div {width}")))
    )
    words = arcs.agg(F.max("total").alias("total")).collect()[0]["total"] or 0
    slots = spark.range(-(-words // block)).select(
        F.col("id").alias("slot"), ((F.col("id") % CIRCLE) * STEP % CIRCLE).alias("point")
    )
    met = (
        slots.withColumn("cell", F.expr(f"point div {width}"))
        .join(by_cell.select("rank", "first", "last", "cell"), "cell")
        .filter("point >= first AND point < last")
        .select("rank", "slot", F.expr(f"slot div {SLOT_CELL}").alias("part"))
    )
    counts = met.groupBy("rank", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rank", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rank", "part").orderBy("slot")
    turns = met.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["rank", "part"]).select(
        "rank", (F.col("start") + F.col("at")).alias("turn"), "slot"
    )
    unmet = arcs.join(counts.select("rank").distinct(), "rank", "left_anti").select(
        "rank", F.lit(0).cast("long").alias("turn"), (F.col("rank") + -(-words // block)).cast("long").alias("slot")
    )
    return turns.unionByName(unmet)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = "mix",
    weights: tuple[int, ...] = WEIGHTS,
    share: int = SHARE,
    most_reads: int = MOST_READS,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: one row per input row with doc_id, source, size, source_size,
    target, row (its place among equal ids) and the words taken from it.
    pieces: slot, doc_id, first word, words, in the order of the mix.

    A null or empty text has no words and is never taken; a null source is a
    source, last in order.  Rows with equal ids are told apart by their size and
    a running number within the id, so repeated rows count as often as they
    occur.  A null id is an id.  An empty table gives empty results.  Columns
    beside the three named are not read.
    """
    sized = store(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    numbered = sized.withColumn(
        "row", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "size"))
    ).withColumn("digest", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("row").cast("string"))))
    targets = store(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("words")), weights, share, most_reads), "mix-targets"
    )
    turns = store(schedule(targets, block), "mix-turns")
    # blocks of each source: the first ``longer`` of them have one word more than ``short``
    counted = turns.groupBy("rank").agg(F.count("*").alias("turns"))
    blocks = (
        targets.filter("take > 0")
        .join(counted, "rank")
        .withColumn("blocks", F.least("turns", "take"))
        .select(
            F.col("source").alias("of"), "rank", "words", "take", "blocks",
            F.expr("take div blocks").alias("short"), (F.col("take") % F.col("blocks")).alias("longer"),
        )
    )
    placed = store(_stream(numbered).join(blocks, F.col("at_source").eqNullSafe(F.col("of"))).drop("of"), "mix-placed")
    # a document's place in each reading of its source, as far as the mix goes
    read = (
        placed.filter("size > 0")
        .withColumn("reading", F.explode(F.sequence(F.lit(0), F.lit(most_reads - 1))))
        .withColumn("from", F.col("start") + F.col("reading") * F.col("words"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take")))
        .filter("to > from")
    )
    first = lambda turn: F.expr(f"({turn}) * short + least({turn}, longer)")
    holding = lambda word: F.expr(
        f"if({word} < longer * (short + 1), ({word}) div (short + 1), longer + ({word} - longer * (short + 1)) div short)"
    )
    pieces = (
        read.withColumn("turn", F.explode(F.sequence(holding("from"), holding("(to - 1)"))))
        .withColumn("low", F.greatest(F.col("from"), first("turn")))
        .withColumn("high", F.least(F.col("to"), first("(turn + 1)")))
        .join(turns, ["rank", "turn"])
        .select("slot", "doc_id", "row", (F.col("low") - F.col("from")).alias("first_word"), (F.col("high") - F.col("low")).alias("words"))
    )
    taken = pieces.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("at")).agg(F.sum("words").alias("taken"))
    documents = (
        numbered.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("at")), "left")
        .drop("id", "at", "digest")
        .join(targets.select(F.col("source").alias("of"), F.col("words").alias("source_size"), "target"), F.col("source").eqNullSafe(F.col("of")))
        .select("doc_id", "row", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
    return documents, pieces


def _stream(numbered: DataFrame) -> DataFrame:
    """Adds ``start``, the words before a document in its source's shuffled stream."""
    cell = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % SHUFFLE_CELLS
    celled = numbered.withColumn("cell", cell).withColumnRenamed("source", "at_source")
    sums = celled.groupBy("at_source", "cell").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("at_source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("at_source").alias("of"), F.col("cell").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("at_source", "cell").orderBy("digest", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        celled.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("at_source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("in")))
        .select("doc_id", "row", "size", "at_source", (F.col("base") + F.col("inner")).alias("start"))
    )
