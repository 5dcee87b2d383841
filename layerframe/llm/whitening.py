"""Embedding whitening by QDWH spectral divide-and-conquer.

Vectors become integers, so their number, sums and deviations are exact.  The
covariance of the distinct vectors is summed over tasks, each centring before it
multiplies.  Its eigenvectors come from polar decompositions: the polar factor
of the covariance less a shift, found by dynamically weighted Halley steps with
QR or Cholesky factors, is the sign of its eigenvalues, which gives the
projector onto those above the shift; bases of both sides split the matrix in
two, and each side is split again until every part is a single component or a
multiple of the identity.  Components, whose size follows the width of the
vectors and not their number, are broadcast and applied row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerframe.llm.common import store

SCALE, OFFSET, TOP = 64, 1_000_000, 16
#: Entries from here on have no exact whole number in double precision; they count as not finite.
LARGEST = float(1 << 46)
#: Partial sums of tasks are added in so many groups first.
SALTS = 64
EPS = np.finfo(float).eps
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``base`` is the whole part of the mean, ``rest`` / n what is left of it."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) squared, exact; null where a long cannot hold it."""
        d = x - self.base
        largest = (float(np.abs(d).max(initial=0)) + 1.0) * self.n
        if largest * largest * max(1, d.shape[1]) < 2.0**62:
            return (np.square(d * self.n - self.rest).sum(axis=1)).tolist()
        wide = np.square(d.astype(object) * self.n - self.rest.astype(object)).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in wide]


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): whole numbers of the usable vectors, eight little-endian bytes each, one width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            good = np.isfinite(flat) & (np.abs(flat) < LARGEST)
            whole = (np.floor(SCALE * np.where(good, flat, 0.0)).astype("<i8") + OFFSET).astype("<i8")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~good)])
            null = lists.is_null().to_numpy(zero_copy_only=False)
            out = [
                None if null[i] or bad[e] > bad[e - s] else whole[e - s : e].tobytes()
                for i, (s, e) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "x"])

    plain = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = store(plain.mapInArrow(run, "vec_id long, x binary").filter("x IS NOT NULL"), "whole-vectors")
    widths = rows.agg(F.max(F.octet_length("x")).alias("most"), F.min(F.octet_length("x")).alias("least")).first()
    if widths["most"] == widths["least"]:
        return rows
    zeros = F.lit(np.full(widths["most"] // 8, OFFSET, "<i8").tobytes())
    filling = F.substring(zeros, F.lit(1), F.lit(widths["most"]) - F.octet_length("x"))
    return rows.withColumn("x", F.concat("x", filling))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def summed(vectors: DataFrame, width: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over all rows, a matrix of ``shape``.

    Tasks send one row per row of the matrix; they are added in two levels, so
    that no task adds up what every task sent.
    """
    schema = "i int, salt int, v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = np.zeros(shape), TaskContext.get()
        for batch in batches:
            if len(batch):
                total += part(matrix(batch.column("x"), width))
        salt = (task.partitionId() if task else 0) % SALTS
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(shape[0]), pa.int32()), "salt": pa.array([salt] * shape[0], pa.int32()), "v": [r.tobytes() for r in total]}
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(shape[1])
        for v in table["v"].to_pylist():
            total += np.frombuffer(v)
        return pa.table({"i": table["i"][:1].cast(pa.int32()), "salt": table["salt"][:1].cast(pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    sent = vectors.select("x").mapInArrow(run, schema)
    rows = sent.groupBy("i", "salt").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema).collect()
    out = np.zeros(shape)
    for r in rows:
        out[r["i"]] = np.frombuffer(r["v"])
    return out


def whole_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, object), 0
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("x"), width)
                total, n = total + x.sum(axis=0).astype(object), n + len(x)
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(range(width + 1), pa.int32()), "s": pa.array([Decimal(int(t)) for t in [*total, n]], pa.decimal128(38, 0))}
        )

    sums = vectors.select("x").mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s"))
    found = {r["at"]: int(r["s"]) for r in sums.collect()}
    return found.get(width, 0), [found.get(i, 0) for i in range(width)]


def polar_sign(h: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH steps."""
    m = len(h)
    x = h / np.abs(h).sum(axis=0).max()
    try:
        low = 0.9 / np.abs(np.linalg.inv(x)).sum(axis=0).max()
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS / 4), 1.0)
    for _ in range(40):
        square = low * low
        d = np.cbrt(4.0 * max(0.0, 1.0 - square) / (square * square))
        a = math.sqrt(1 + d) + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - square) / (square * math.sqrt(1 + d)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([math.sqrt(c) * x, np.eye(m)]))[0]
            after = b / c * x + (a - b / c) / math.sqrt(c) * (q[:m] @ q[m:].T)
        else:
            z = np.linalg.cholesky(np.eye(m) + c * x.T @ x)
            after = b / c * x + (a - b / c) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        after = (after + after.T) / 2
        moved, x = np.linalg.norm(after - x), after
        low = min(1.0, low * (a + b * square) / (1 + c * square))
        if abs(1 - low) < 10 * EPS and moved < m * 10 * EPS ** (1 / 3):
            # one Newton-Schulz step takes what rounding left
            return 1.5 * x - 0.5 * (x @ x @ x)
    return x


def split(a: np.ndarray, unit: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the eigenvectors above and below a shift; nothing for a multiple of the identity."""
    m = len(a)
    middle = np.trace(a) / m
    if np.abs(a - middle * np.eye(m)).max() <= 4 * EPS * unit:
        return None
    diagonal = np.diag(a)
    spread = max(diagonal.max() - diagonal.min(), np.abs(a - np.diag(diagonal)).max())
    # the mean of the eigenvalues always lies between two of them; others are for one that meets the shift
    for shift in (middle, np.median(diagonal), *(middle + spread * f for f in (0.013, -0.017, 0.11, -0.13, 0.29, -0.31))):
        h = a - shift * np.eye(m)
        if not np.abs(h).max():
            continue
        above = (polar_sign(h) + np.eye(m)) / 2
        rank = int(round(np.trace(above)))
        if not 0 < rank < m or np.abs(above @ above - above).max() > 1e-10:
            continue
        basis = above @ rng.standard_normal((m, rank))
        for _ in range(2):
            basis = above @ np.linalg.qr(basis)[0]
        q = np.linalg.qr(basis, mode="complete")[0]
        return q[:, :rank], q[:, rank:]
    return None


def leading_components(v: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance with their unit eigenvectors, one per row.

    Sides below the shift are only split while too few components are known.
    Eigenvalues that are zero to rounding have no whitened value and are left out.
    """
    unit, rng = max(float(np.abs(v).max(initial=0)), np.finfo(float).tiny), np.random.default_rng(7)
    found: list[np.ndarray] = []
    open_parts = [np.eye(len(v))]
    while open_parts and len(found) < top:
        basis = open_parts.pop()
        parts = None
        if basis.shape[1] > 1:
            a = basis.T @ v @ basis
            parts = split((a + a.T) / 2, unit, rng)
        if parts is None:
            found.extend(basis.T)
        else:
            open_parts += [np.linalg.qr(basis @ parts[1])[0], np.linalg.qr(basis @ parts[0])[0]]
    vectors = np.array(found).reshape(-1, len(v))
    values = np.einsum("ij,jk,ik->i", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")[:top]
    order = order[values[order] > len(v) * 8 * EPS * max(values.max(initial=0.0), 0.0)]
    return values[order], vectors[order]


def fit(points: DataFrame, width: int, top: int = TOP) -> Whitening | None:
    """Whitening of a table of distinct vectors ``x``; nothing if all are the same or there is none."""
    n, sums = whole_sums(points, width)
    if not n or not width:
        return None
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    bare = Whitening(n, base, rest, np.zeros((0, width)), np.zeros(0), 0.0, 0.0)

    def squares(x: np.ndarray) -> np.ndarray:
        c = bare.centred(x)
        return c.T @ c

    covariance = summed(points, width, (width, width), squares) / n
    covariance = (covariance + covariance.T) / 2
    values, components = leading_components(covariance, top)
    if not len(values):
        return None
    model = Whitening(n, base, rest, components, values, float(np.trace(covariance)), 0.0)

    def checks(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    k = len(values)
    total = summed(points, width, (k + 1, k), checks) / n
    # whitened rows are centred already; what rounding left of their mean is taken out
    error = total[:k] - np.outer(total[k], total[k]) - np.eye(k)
    return Whitening(n, base, rest, components, values, model.trace, float(np.abs(error).max()))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """One row per usable vector and component, numbered from 1 by falling eigenvalue.

    Vectors that are null or hold a null or non-finite entry (or one beyond 2^46,
    which has no exact whole number) are dropped.  Each distinct vector counts
    once in the fit; repeated rows and null ids all get their rows.  A vector
    shorter than the widest counts as zero where it has no entries.  Components
    without variance have no whitened value and no rows, so a table of one
    distinct vector, or of none, gives no rows.  ``deviation`` is null where a
    long cannot hold it.  Other columns are not read.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, id_col, vector_col)
    width = (rows.agg(F.max(F.octet_length("x")).alias("w")).first()["w"] or 0) // 8
    points = store(rows.select("x").distinct(), "distinct-vectors")
    model = fit(points, width, top) if width else None
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                x = matrix(part.column("x"), width)
                deviations = pa.array(m.deviations(x), pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column("vec_id").take(each),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(each), m.n, np.int64)),
                        "deviation": deviations.take(each),
                        "whitened": pa.array(m.whitened(x).reshape(-1)),
                        "explained": pa.array(np.tile(m.values / m.trace, len(x))),
                        "identity_error": pa.array(np.full(len(each), m.identity_error)),
                    }
                )

    return rows.mapInArrow(run, SCHEMA)
