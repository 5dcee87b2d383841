"""Near duplicates: SetSketch registers, banded, estimated jointly, verified.

1. Every text becomes its set of word shingles and a SetSketch of it: registers
   hold, on an exponential scale, the truncated minima of the points that the
   elements throw.  Registers of two sketches merge by their maximum, and two
   sets agree in a register with the probability of their similarity.
2. Texts with equal sets are one class from here on, however many they are.
3. Bands of registers bring classes together.  In each bucket every class meets
   one leader; the joint likelihood of both sketches, with the sizes known,
   drops what cannot be similar.  Each class first checks its best leader on the
   full sets, which joins most of a group; pairs inside a component need no
   further check.
4. Buckets that still hold different components are gathered around the one they
   hold most of, each class once.  There all classes of different components
   meet in blocks of bounded size, inside tasks, likelihood first and full sets
   after it; only links that join components come out.

So no link is lost to a hub or a crowded bucket: the only loss is that of the
bands and the likelihood (about 1e-7 and 1e-4 for a pair exactly at 0.8, and
less above).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerframe.llm.common import ids_and_texts, store
from layerframe.llm.components import components
from layerframe.llm.shingles import mix64, shingle_sets

#: Registers of a sketch (a power of two), base of their scale, rate, largest value.
REGISTERS, BASE, RATE, LARGEST = 256, 1.001, 20.0, 65_535
BANDS, ROWS = 40, 5
#: Similarity of a link, in hundredths, and what the likelihood may be short of it.
SIMILAR, MARGIN = 80, 0.1
#: Classes of one block of a crowded neighbourhood, and hashes of their sets, about.
BLOCK, BLOCK_HASHES = 512, 2_000_000
#: Bits of the map that picks texts by id.
MARKS = 1 << 24

SKETCHED = "id long, n long, d1 long, d2 long, registers binary"
SKETCHED_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("registers", pa.binary())])


def sketches(sizes: np.ndarray, hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (rows of uint16) of sets given one after another.

    The points of an element are the order statistics of as many exponentials
    as there are registers, dealt to the registers in an order of its own.  Only
    points early enough to matter are thrown; a set with a register still empty
    is thrown again with more.
    """
    least = np.full((len(sizes), registers), np.inf)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    todo, reach = np.flatnonzero(sizes), math.log(registers) + 3
    while len(todo):
        limit = np.full(len(sizes), -1.0)
        limit[todo] = reach / sizes[todo]
        _throw(least, owner, hashes, limit, registers)
        todo = todo[np.isinf(least[todo]).any(axis=1) | (least[todo].max(axis=1) > limit[todo])]
        reach *= 2
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least / RATE) / math.log(BASE))
    return np.clip(value, 0, LARGEST).astype(np.uint16)


def _throw(least: np.ndarray, owner: np.ndarray, hashes: np.ndarray, limit: np.ndarray, registers: int) -> None:
    within = limit[owner] > 0
    owner, seed = owner[within], hashes[within]
    time, bound, flat = np.zeros(len(owner)), limit[owner], least.reshape(-1)
    dealt = mix64(seed ^ np.uint64(0x5851F42D4C957F2D))
    at = (dealt & np.uint64(registers - 1)).astype(np.int64)
    stride = ((dealt >> np.uint64(32)).astype(np.int64) & (registers - 1)) | 1
    for turn in range(registers):
        drawn = mix64(seed + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)
        uniform = (drawn.astype(np.float64) + 1) * 2.0**-53
        time = time - np.log(uniform) / (registers - turn)
        early = time <= bound
        if not early.all():
            owner, seed, time, bound, at, stride = (x[early] for x in (owner, seed, time, bound, at, stride))
        if not len(owner):
            return
        np.minimum.at(flat, owner * registers + ((at + turn * stride) & (registers - 1)), time)


def estimate(mine: np.ndarray, theirs: np.ndarray, n_mine: np.ndarray, n_theirs: np.ndarray) -> np.ndarray:
    """Similarity of sets by the joint likelihood of their registers, sizes known.

    Registers that are larger, smaller and equal follow p(u - vJ), p(v - uJ) and
    the rest, with p(x) = -log_b(1 - x (b - 1) / b); maximised over a grid.
    """
    larger = (mine > theirs).sum(axis=1)[:, None]
    smaller = (mine < theirs).sum(axis=1)[:, None]
    equal = mine.shape[1] - larger - smaller
    u = (n_mine / (n_mine + n_theirs))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    more, fewer = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    score = larger * np.log(more + tiny) + smaller * np.log(fewer + tiny) + equal * np.log(np.maximum(1 - more - fewer, 0) + tiny)
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def _registers(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint16) for x in column.to_pylist()]) if len(column) else np.zeros((0, REGISTERS), np.uint16)


def sketch_texts(texts: DataFrame, words: int) -> DataFrame:
    """Size, digest of the set, and registers of every text (columns id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch[0]
            for row, sizes, hashes in shingle_sets(batch[1], words):
                regs = sketches(sizes, hashes)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                sums = lambda x: np.add.reduceat(np.append(x, np.uint64(0)), bounds[:-1]) * (sizes > 0)
                d1, d2 = sums(mix64(hashes + np.uint64(1))), sums(mix64(hashes ^ np.uint64(0xDEADBEEFCAFEF00D)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(d1.astype(np.int64)),
                        pa.array(d2.astype(np.int64)),
                        pa.array([r.tobytes() if n else None for r, n in zip(regs, sizes, strict=True)], pa.binary()),
                    ],
                    schema=SKETCHED_ARROW,
                )

    return texts.mapInArrow(run, SKETCHED)


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, id) for each band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                regs = _registers(part.column("registers"))[:, : BANDS * ROWS].astype(np.uint64).reshape(len(part), BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), regs.shape[:2])
                for row in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, row])
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).astype(np.int64)), pa.array(ids, pa.int64())], names=["key", "id"])

    return classes.select("id", "registers").mapInArrow(run, "key long, id long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, likely) for the pairs whose likelihood passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                a, b, na, nb = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "na", "nb"))
                near = estimate(_registers(part.column("ra")), _registers(part.column("rb")), na.astype(float), nb.astype(float))
                good = near >= SIMILAR / 100 - MARGIN
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good]), pa.array(near[good])], names=["a", "b", "likely"])

    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    both = pairs.join(left, "a").join(right, "b").filter("100 * least(na, nb) >= 80 * greatest(na, nb)".replace("80", str(SIMILAR)))
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, likely double")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(c) for c in ("a", "b", "ha", "hb"))
            good = []
            for x, y in zip(left, right, strict=True):
                good.append(similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good, pa.bool_())), b.filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every id has its bit."""
    slot = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    words = ids.select(slot.alias("slot")).select(
        F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 AS INT))").alias("bit")
    )
    marks = np.zeros(MARKS // 64, np.uint64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).collect():  # MARKS / 64 rows at most
        marks[word] = bits & 0xFFFFFFFFFFFFFFFF
    return marks


def full_sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, hashes) of the texts that ``ids`` names, and of a few others.

    Texts are picked by a bitmap where they are read, so none is shuffled; ids
    that share a bit with one of ``ids`` come along and meet nothing later.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_marks(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy().astype(np.uint64)
            wanted = (shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(wanted.astype(bool)))
            for row, sizes, hashes in shingle_sets(batch.column("text"), words):
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                held = [hashes[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(sizes)), pa.array(held, pa.binary())], names=["id", "hashes"])

    marked = texts.filter("id IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(MARKS)).alias("slot"))
    return marked.mapInArrow(run, "id long, hashes binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Are two sets, sorted and distinct, similar enough for a link?"""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILAR * (len(x) + len(y) - both)


def _met_in_blocks(rows: DataFrame) -> DataFrame:
    """(a, b) links that join different components around a hub.

    rows: hub, id, component, n, registers, hashes.  Members of the hub's own
    component need no check among themselves, so they are dealt into blocks of
    their own and meet only the blocks of the others, which meet each other too.
    A group is two blocks.  Inside, the likelihood orders the pairs of different
    components, the full sets decide, and what is joined is not tried again.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, n, side = (table.column(c).to_numpy() for c in ("id", "component", "n", "block"))
        regs = _registers(table.column("registers"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        second = np.flatnonzero(side == key[2].as_py())
        for i in np.flatnonzero(side == key[1].as_py()):
            mine = find(int(comp[i]))
            apart = {c for c in root if find(c) != mine}
            other = second[(comp[second] != comp[i]) & ((ids[second] > ids[i]) | (side[second] != side[i]))]
            small, large = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
            other = other[(100 * small >= SIMILAR * large) & np.isin(comp[other], list(apart))]
            if not len(other):
                continue
            near = estimate(np.broadcast_to(regs[i], (len(other), regs.shape[1])), regs[other], np.full(len(other), float(n[i])), n[other].astype(float))
            for j in other[np.argsort(-near)][: int((near >= SIMILAR / 100 - MARGIN).sum())]:
                mine, theirs = find(int(comp[i])), find(int(comp[j]))
                if mine != theirs and similar(sets[i], sets[j]):
                    root[max(mine, theirs)] = min(mine, theirs)
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    is_own = F.col("component") == F.col("hub")
    held = lambda chosen: F.greatest(
        F.ceil(F.count_if(chosen) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)) / BLOCK_HASHES)
    ).cast("long")
    counts = rows.groupBy("hub").agg(held(is_own).alias("inside"), held(~is_own).alias("outside"))
    # blocks 0, 1, ... hold the others; -1, -2, ... the hub's own
    blocked = (
        rows.withColumn("own", is_own)
        .join(counts, "hub")
        .filter("outside > 0")
        .withColumn("block", F.expr("if(own, -1 - pmod(xxhash64(id), inside), pmod(xxhash64(id), outside))"))
        .withColumn("meets", F.explode(F.expr("if(own, sequence(0L, outside - 1), sequence(-inside, outside - 1))")))
        .select(
            "hub", F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high"), "block", "id", "component", "n", "registers", "hashes"
        )
        # the joins leave a hub's rows together; each pair of blocks may go anywhere
        .repartition("hub", "low", "high")
    )
    return blocked.groupBy("hub", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Component of every text under links of similarity 0.8 or more of word shingles.

    One row per input row: doc_id, n_shingles, component_id (smallest id
    reachable), kept (whether that is its own).  Words are what spaces and tabs,
    line and page breaks separate, A-Z in lower case.  A text with fewer words
    than a shingle is one shingle; null, empty and wordless texts have none and
    are their own component.  Rows that repeat an id share its component; a null
    id takes part in the class of its set but represents it only for itself.
    Other columns are not read.
    """
    texts = ids_and_texts(df, id_col, text_col)
    sketched = store(sketch_texts(texts, words), "sketches")
    some = sketched.filter("n > 0 AND id IS NOT NULL")
    named = store(some.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "set-classes")
    classes = store(
        some.join(named.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "registers"),
        "set-sketches",
    )
    labels = _linked(texts, classes, words)
    known = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("component", "rep").alias("component")
    )
    met = sketched.select("id", "n", "d1", "d2").join(
        known, (F.col("n") > 0) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left"
    )
    component = F.coalesce("component", "id")
    return met.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _linked(texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(id, component) of the classes that have a link."""
    bands = band_keys(classes)
    chosen = F.min(F.struct(F.xxhash64("id", "key").alias("order"), F.col("id").alias("leader")))
    shared = bands.groupBy("key").agg(F.count("*").alias("members"), chosen.alias("first")).filter("members > 1")
    members = store(bands.join(shared.select("key", F.col("first.leader").alias("leader")), "key"), "band-members")
    pairs = members.filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    likely = store(_likely(pairs, classes), "likely-pairs")
    sets = store(
        full_sets(texts, likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), words).dropDuplicates(["id"]),
        "full-sets",
    )
    # one pair per class first, its likeliest: that joins most of what belongs together
    ends = likely.select(F.col("a").alias("x"), F.col("b").alias("y"), "likely").union(likely.select("b", "a", "likely"))
    best = ends.groupBy("x").agg(F.max(F.struct("likely", "y")).alias("with")).select("x", F.col("with.y").alias("y"))
    tried = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = store(_verified(tried, sets), "links-verified")
    joined = components(links)
    # buckets that still hold several components; those with one in common gather around it, each class once
    placed = store(
        members.select("key", "id").join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")),
        "bucket-components",
    )
    # a bucket of two is met only for a likely pair that was not tried; any other pair of it has been ruled out
    untried = likely.select("a", "b").join(tried, ["a", "b"], "left_anti").withColumn("untried", F.lit(True))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    hubs = shares.groupBy("key").agg(
        F.max(F.struct("n", (-F.col("component")).alias("last"))).alias("top"), F.count("*").alias("several"), F.sum("n").alias("members"),
        F.min("a").alias("a"), F.max("b").alias("b"),
    ).filter("several > 1").join(untried, ["a", "b"], "left").filter("members > 2 OR untried")
    gathered = placed.join(hubs.select("key", (-F.col("top.last")).alias("hub")), "key").select("hub", "id", "component").distinct()
    gathered = store(gathered, "hub-members")
    missing = store(gathered.select("id").distinct().join(sets.select("id"), "id", "left_anti"), "sets-missing")
    every = sets
    if not missing.isEmpty():
        new = store(full_sets(texts, missing, words).dropDuplicates(["id"]), "full-sets")
        every = sets.unionByName(new.join(sets.select("id"), "id", "left_anti"))
    rest = gathered.join(classes, "id").join(every, "id")
    late = store(_met_in_blocks(rest), "links-late")
    return components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(late))
