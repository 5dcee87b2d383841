"""Exact top-k inner products over norm-sorted blocks of rotated vectors.

Vectors are integers after scaling, so scores are exact.  They are rotated by
the eigenvectors of their second moments (an SVD of the whole table), which
moves most of every inner product into the first coordinates, and dealt into
bands of falling length.  Queries, in blocks of fixed size, first meet blocks of
the longest vectors, which gives each a k-th best score so far; then each query
block meets exactly the further blocks whose length could still beat it, by an
equi-join on the block.  Inside a pair of blocks, partial sums of the rotated
coordinates and the Cauchy-Schwarz bound on the rest prune candidates in steps;
what survives is scored with the exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerframe.llm.common import store

SCALE, TOP, EVERY = 1024, 10, 100
#: Vectors of a block, queries of a block.
BLOCK, QUERIES = 2048, 256
#: Bands of length per doubling.
BANDS = 8
#: Shares of the rotated coordinates at which partial sums are checked.
STEPS = (0.125, 0.25, 0.5)
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v, length2) of the vectors without nulls or non-finite components."""
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(good, values).alias("x")).filter("x IS NOT NULL AND id IS NOT NULL")
    whole = rows.select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return whole.withColumn("length2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def moments(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products, one matrix per task added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch[0], width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.reshape(-1))], names=["at", "s"])

    out = np.zeros(width * width)
    for at, s in vectors.select("v").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s")).collect():
        out[at] = s
    return out.reshape(width, width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One row per block: the keys, its ids and integers as bytes, its greatest length."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.lexsort((table["id"].to_numpy(), -table["length2"].to_numpy()))
        ids = table["id"].to_numpy()[order]
        values = _matrix(table["v"].chunk(0), width)[order].astype("<i8")
        longest = math.sqrt(float(table["length2"].to_numpy().max()))
        return pa.table(
            {name: pa.array([k.as_py()], pa.int64()) for name, k in zip(keys, key, strict=True)}
            | {"ids": pa.array([ids.astype("<i8").tobytes()]), "values": pa.array([values.tobytes()]), "longest": [longest]}
        )

    schema = ", ".join(f"{k} long" for k in keys) + ", ids binary, values binary, longest double"
    return rows.groupBy(*keys).applyInArrow(run, schema)


def best_in_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, rotation: np.ndarray, floor: np.ndarray, top: int
) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of the block's best for each query that reach ``floor``.

    Rotated in floating point with a margin for its rounding; ties of the k-th
    score all stay, so the smaller id can win later.
    """
    q, x = queries @ rotation, values @ rotation
    width = q.shape[1]
    q_len, x_len = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    slack = 1e-9 * (q_len[:, None] * x_len[None, :]) + 1e-6
    alive = q_len[:, None] * x_len[None, :] + slack >= floor[:, None]
    done, partial = 0, np.zeros(alive.shape)
    for step in sorted({int(width * s) for s in STEPS} - {0, width}):
        partial += q[:, done:step] @ x[:, done:step].T
        rest = np.linalg.norm(q[:, step:], axis=1)[:, None] * np.linalg.norm(x[:, step:], axis=1)[None, :]
        alive &= partial + rest + slack >= floor[:, None]
        done = step
        if not alive.any():
            return
    for row in np.flatnonzero(alive.any(axis=1)):
        at = np.flatnonzero(alive[row])
        at = at[ids[at] != query_ids[row]]
        score = values[at] @ queries[row]
        if len(at) > top:
            least = np.partition(score, len(score) - top)[len(score) - top]
            at, score = at[score >= least], score[score >= least]
            order = np.lexsort((ids[at], -score))[:top]
            at, score = at[order], score[order]
        for i, s in zip(at, score, strict=True):
            if s >= floor[row]:
                yield int(query_ids[row]), int(ids[i]), int(s)


def _met(pairs: DataFrame, rotation: np.ndarray, width: int, top: int) -> DataFrame:
    """The best of every pair of a query block and a candidate block.

    An RDD, because its batches of rows follow their bytes: a pair of blocks
    is several megabytes, and a batch of thousands would not fit.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(rotation)

    def run(rows):
        for r in rows:
            ids, query_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
            values = np.frombuffer(r["values"], "<i8").reshape(-1, width)
            queries = np.frombuffer(r["q_values"], "<i8").reshape(-1, width)
            floor = np.frombuffer(r["floors"], "<f8") if r["floors"] is not None else np.full(len(query_ids), -np.inf)
            yield from best_in_block(query_ids, queries, ids, values, shared.value, floor, top)

    return pairs.sparkSession.createDataFrame(pairs.rdd.mapPartitions(run), FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best of each query: partial sorts per salt, then per query."""
    from pyspark.sql import Window

    order = [F.col("score").desc(), F.col("vec_id")]
    salted = found.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return last.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def top_inner_products(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, every: int = EVERY, scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best of every query row.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own; ties go to the smaller id.  Vectors that are null
    or hold a null or non-finite component, and rows without an id, take no
    part; neither do empty vectors.  A vector shorter than the widest counts as
    zero where it has no components, so each pair is scored over what both
    have.  Rows that repeat an id
    with the same vector count once.  Other columns are not read.
    """
    spark = df.sparkSession
    vectors = whole_numbers(df, id_col, vector_col, scale)
    width = vectors.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    band = F.greatest(F.floor(F.log2(F.greatest(F.col("length2"), F.lit(1.0))) * (BANDS / 2)), F.lit(0)).cast("long")
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), width - F.size("v")))
    vectors = store(
        vectors.filter(F.size("v") > 0).withColumn("v", filled).distinct().withColumn("band", band), "vectors"
    )
    rotation = np.linalg.eigh(moments(vectors, width))[1][:, ::-1].copy()
    # as many rows as there are bands of length: at most a few hundred, whatever the table
    held = {r["band"]: r["n"] for r in vectors.groupBy("band").agg(F.count("*").alias("n")).collect()}
    slots = {b: -(-n // BLOCK) for b, n in held.items()}
    per_band = F.create_map(*[x for b, n in slots.items() for x in (F.lit(b), F.lit(n))])
    dealt = vectors.withColumn("slot", F.pmod(F.xxhash64("id"), per_band[F.col("band")]))
    blocks = store(_packed(dealt, ["band", "slot"], width), "vector-blocks")

    asked = vectors.filter(F.col("id") % every == 0)
    n_asked = asked.count()
    groups = max(1, -(-n_asked // QUERIES))
    asked_blocks = store(
        _packed(asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))), ["group"], width), "query-blocks"
    ).select("group", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.col("longest").alias("q_longest"))

    # the longest vectors first: bands from the top until they hold enough
    opening, enough = [], 0
    for b in sorted(held, reverse=True):
        opening.append(b)
        enough += held[b]
        if enough > top:
            break
    lead = opening[-1]
    # of a large band one block is enough to begin with; its others come later
    start = [(b, 0 if slots[b] > 1 and b == lead else s) for b in opening for s in range(1 if b == lead else slots[b])]
    first = asked_blocks.withColumn("to", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(s).alias("slot")) for b, s in start])))
    met_first = first.select("*", "to.band", "to.slot").join(blocks, ["band", "slot"]).withColumn("floors", F.lit(None).cast("binary"))
    begun = store(_ranked(_met(met_first, rotation, width, top), top), "top-begun")

    floors = begun.groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score")).alias("floor"))
    asked_rows = asked.select("id", "v", "length2", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"))
    with_floor = asked_rows.join(floors, F.col("id") == F.col("query_id"), "left")
    # candidates shorter than this cannot reach the k-th score of any query of the block
    needs = F.when(F.col("floor").isNull() | (F.col("floor") <= 0), F.lit(0.0)).otherwise(F.col("floor") / F.sqrt("length2"))
    reach = with_floor.groupBy("group").agg(
        F.min(needs).alias("needs"), F.collect_list(F.struct("id", F.col("floor").cast("double").alias("floor"))).alias("each")
    )

    def lined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Floors in the order of the block's queries."""
        for batch in batches:
            out = []
            for ids, each in zip(batch.column("q_ids").to_pylist(), batch.column("each").to_pylist(), strict=True):
                known = {e["id"]: -np.inf if e["floor"] is None else e["floor"] for e in each}
                out.append(np.array([known[i] for i in np.frombuffer(ids, "<i8").tolist()], "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("needs"), pa.array(out, pa.binary())], names=["group", "needs", "floors"])

    lined = asked_blocks.select("group", "q_ids").join(reach, "group").select("group", "q_ids", "needs", "each").mapInArrow(lined_up, "group long, needs double, floors binary")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(n).alias("n")) for b, n in slots.items()])
    # a band's vectors are shorter than the lower end of the next; rounding of the logarithm is covered by one more
    open_bands = F.filter(bands, lambda b: F.pow(F.lit(2.0), (b["band"] + 2) / float(BANDS)) >= F.col("needs"))
    further = (
        lined.withColumn("b", F.explode(open_bands))
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.n").cast("long") - 1)))
        .select("group", "floors", F.col("b.band").cast("long").alias("band"), "slot")
    )
    done = spark.createDataFrame([(int(b), int(s)) for b, s in start], "band long, slot long")
    pairs = further.join(done, ["band", "slot"], "left_anti").join(asked_blocks, "group").join(blocks, ["band", "slot"])
    found = _met(pairs, rotation, width, top).unionByName(begun.select("query_id", "vec_id", "score"))
    return _ranked(found, top)
