"""Merkle manifest of a table: leaves, subroots per group, a root, and a proof per row.

Every three consecutive nodes of a group become one, level by level, until one
node is left; the groups' last nodes become the root in the same way.  Leaves
are numbered inside their group by a range partition and one count per (group,
partition), so a group that holds most rows is spread like any other.

Five levels are one window: over blocks of 3^5 consecutive nodes in order, the
node of level k stands on every 3^k-th row, lag and lead at fixed offsets of
3^k and 2 * 3^k rows supply its siblings, masked by its slot in the run of three
and by the run's length, and first-child rows hash the parent.  A row's own path
is the last one seen of each level.  The blocks' tops are the next tier's nodes,
243 times fewer, so tiers grow with the logarithm of the largest group.  What is
above a block joins it on (group, block), a key of 243 rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerframe.llm.common import store

FAN = 3
#: Levels of one window; its blocks hold FAN ** LEVELS nodes.
LEVELS = 5
#: monotonically_increasing_id keeps the partition above this bit.
ROW_BITS = 33


def joined(parts: Sequence[Column]) -> Column:
    """The digest of digests or fields written one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's bytes in UTF-8 behind their number and a colon."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return joined([field(c) for c in columns])


def group_key(column: Column) -> Column:
    """Never null; null sorts first, others by their bytes."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("n"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos`` from 0 inside ``grp`` and its number of rows ``n``.

    Equal rows get any of their places.  The order is stored once, with a unique
    number behind it, so recomputed tasks see the same one.
    """
    once = store(rows.withColumn("row", F.monotonically_increasing_id()), "manifest-rows")
    keys = ["grp", *order, "row"]
    ranged = once.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")
    placed = store(ranged.withColumn("place", F.monotonically_increasing_id()), "manifest-order")
    placed = placed.withColumn("part", F.shiftright("place", ROW_BITS))
    parts = placed.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "grp", "part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(group).alias("n")
    )
    return (
        placed.join(starts, ["grp", "part"])
        .withColumn("pos", F.col("start") + F.col("place") - F.col("first"))
        .drop("part", "place", "first", "start")
    )


def _levels(nodes: DataFrame) -> DataFrame:
    """One tier: adds ``block``, ``path`` (siblings on the left and on the right, per level) and ``top``."""
    size = FAN**LEVELS
    rows = nodes.withColumn("block", F.expr(f"pos div {size}"))
    inside = Window.partitionBy("grp", "block").orderBy("pos")
    rows = rows.withColumn("node0", F.col("digest"))
    none = F.lit("")
    for level in range(LEVELS):
        step, node = FAN**level, f"node{level}"
        count = F.expr(f"(n + {step - 1}) div {step}")
        index = F.expr(f"pos div {step}")
        slot = F.pmod(index, F.lit(FAN))
        run = F.least(F.lit(FAN).cast("long"), count - index + slot)
        rows = rows.withColumns(
            {f"{way}{k}": f(node, k * step).over(inside) for way, f in (("lag", F.lag), ("lead", F.lead)) for k in (1, 2)}
        )
        left = F.when(slot == 1, F.col("lag1")).when(slot == 2, F.concat("lag2", "lag1")).otherwise(none)
        right = F.concat(
            F.when(slot + 1 < run, F.col("lead1")).otherwise(none), F.when(slot + 2 < run, F.col("lead2")).otherwise(none)
        )
        here = F.pmod("pos", F.lit(step)) == 0
        rows = rows.withColumn(f"pair{level}", F.when(here & (count > 1), F.struct(left.alias("l"), right.alias("r"))))
        parent = F.when(count > 1, joined([F.col(node), F.col(f"pair{level}.r")])).otherwise(F.col(node))
        rows = rows.withColumn(f"node{level + 1}", F.when(F.pmod("pos", F.lit(step * FAN)) == 0, parent))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = [F.last(f"pair{level}", ignorenulls=True).over(so_far) for level in range(LEVELS)]
    return rows.select(*nodes.columns, "block", F.array_compact(F.array(*pairs)).alias("path"), F.col(f"node{LEVELS}").alias("top"))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers from the leaves up, and (grp, digest) of each group's last node."""
    size, tiers = FAN**LEVELS, []
    while True:
        tiers.append(_levels(nodes))
        tops = tiers[-1].filter(F.pmod("pos", F.lit(size)) == 0).select(
            "grp", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest")
        )
        nodes = store(tops, "manifest-tops")
        if (nodes.agg(F.max("n").alias("n")).first()["n"] or 0) <= 1:
            return tiers, nodes.select("grp", "digest")


def _descend(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with their whole ``path`` and the columns of ``above`` (grp, pos, path, ...)."""
    kept = [c for c in above.columns if c not in ("grp", "pos", "path")]
    for tier in reversed(tiers):
        over = above.select("grp", F.col("pos").alias("block"), F.col("path").alias("over"), *kept)
        rows = tier.join(over, ["grp", "block"]).withColumn("path", F.concat("path", "over")).drop("over", "block", "top")
        if tier is tiers[0]:
            return rows
        above = store(rows.select("grp", "pos", "path", *kept), "manifest-paths")


def proofs(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (grp, digest, and others) with ``pos``, ``n``, ``path``, ``subroot`` and ``root``.

    ``path`` lists, from the leaf to the root, what stands left and right of the
    node on the way; a run of one has neither.  An empty table has no rows and
    no root.
    """
    tiers, subroots = _climb(numbered(leaves, order))
    groups = subroots.select(
        F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.col("digest").alias("subroot")
    )
    upper, roots = _climb(numbered(groups, ["name"]))
    start = roots.select("grp", F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<l:string,r:string>>").alias("path"), F.col("digest").alias("root"))
    whole = _descend(upper, start)
    per_group = store(whole.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"), "manifest-groups")
    return _descend(tiers, per_group)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest over all siblings, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def manifest(df: DataFrame, columns: Sequence[str], group_col: str, id_col: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, path, and ``seen``: the leaf of the row as ``changed`` alters its columns.

    A leaf covers ``columns`` in the order given.  Leaves of a group ascend by
    id, null first, and by digest where ids repeat.  Nulls in any column count as
    ``-``; empty texts as ``0:``; a text is hashed whole whatever its length;
    repeated rows are leaves of their own; other columns are not read, so their
    names don't matter.
    """
    changed = changed or {}
    leaves = df.select(
        F.col(id_col).alias("id"),
        group_key(F.col(group_col)).alias("grp"),
        leaf_digest(*[F.col(c) for c in columns]).alias("digest"),
        leaf_digest(*[changed.get(c, F.col(c)) for c in columns]).alias("seen"),
    )
    return proofs(leaves, ["id", "digest"]).select("id", F.col("digest").alias("leaf"), "subroot", "root", "path", "seen")
