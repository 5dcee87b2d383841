"""Language identification from character n-grams.

Multinomial logistic regression over hashed TF-IDF n-grams, trained row by row
with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties),
then calibrated with one temperature on rows the training did not see.

Document frequencies are counted over every training row.  The classifier is
fitted on a bounded sample of them: ``SAMPLE`` rows per language, chosen by hash.
Everything else is row-local.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.llm.shingles import mix64

#: Lengths of the n-grams, and slots they are hashed to.
ORDERS, SLOTS = (1, 2, 3), 1 << 14
#: Training rows per language, about; the bound of what is fitted on.
SAMPLE = 1000
#: One sampled row in so many only calibrates.
CALIBRATE = 5
#: Follow-the-regularised-leader: rate, smoothing, penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1e-3, 1e-3, 3
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(id_col: Column) -> Column:
    """Rows that training never sees, by their id; a null id may be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(slots, counts) of the n-grams of a whole text; None if it has no letter.

    Lower case; runs of anything but letters are one blank, also at both ends.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    if codes[-2] == 32:
        codes = codes[:-1]
    if codes[1] == 32:
        codes = codes[1:]
    total = np.zeros(SLOTS, np.int64)
    for order in ORDERS:
        if len(codes) >= order:
            gram = np.full(len(codes) - order + 1, order, np.uint64)
            for place in range(order):
                gram = gram * np.uint64(0x110000) + codes[place : place + len(gram)]
            total += np.bincount((mix64(gram) >> np.uint64(40)).astype(np.int64) % SLOTS, minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def scores(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return vector(slots, counts, self.idf) @ self.weights[slots] if len(self.languages) else np.zeros(0)

    def predict(self, text: str) -> tuple[str, float]:
        found = features(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        shares = softmax(self.scores(*found) / self.temperature)
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def vector(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length-normalised TF-IDF values at ``slots``."""
    value = (1 + np.log(counts)) * idf[slots]
    return value / max(float(np.linalg.norm(value)), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray) -> Model:
    """Train on rows of (slots, counts, language), calibrate on every fifth."""
    train = [r for i, r in enumerate(rows) if i % CALIBRATE]
    check = [r for i, r in enumerate(rows) if not i % CALIBRATE]
    shape = (len(idf), len(languages))
    z, squares, weights = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for _ in range(PASSES):
        for slots, counts, language in train:
            x = vector(slots, counts, idf)
            zs, ns = z[slots], squares[slots]
            # the leader under both penalties: zero where |z| stays below L1
            now = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            error = softmax(x @ now)
            error[language] -= 1
            slope = x[:, None] * error[None, :]
            grown = ns + slope * slope
            z[slots] = zs + slope - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * now
            squares[slots] = grown
    weights = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(squares)) / ALPHA + L2))
    model = Model(languages, idf, weights)
    if check:
        model.temperature = temperature(np.stack([model.scores(s, c) for s, c, _ in check]), np.array([y for *_, y in check]))
    return model


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    One row in n + 2 is taken to be wrong, so faultless scores stay below 1.
    """
    doubt = 1 / (len(truth) + 2)

    def loss(t: float) -> float:
        logs = np.log(softmax(scores / math.exp(t)) + 1e-300)
        return float(-((1 - doubt) * logs[np.arange(len(truth)), truth] + doubt * logs.mean(axis=1)).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows that are not held out and have a text and a language."""
    rows = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch[0]:
                if (found := features(text.as_py())) is not None:
                    seen[found[0]] += 1
                    n += 1
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, SLOTS)), pa.array(np.append(seen[slots], n))], names=["slot", "n"])

    # one row per slot: its number is fixed
    counted = rows.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(SLOTS + 1, np.int64)
    for slot, n in counted:
        seen[slot] = n
    idf = np.log((1 + seen[SLOTS]) / (1 + seen[:SLOTS])) + 1

    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return Model([], idf, np.zeros((SLOTS, 0)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / per[lang])))])
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(drawn < share[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, lang, text in zip(*(batch[i] for i in range(3)), strict=True):
                if (found := features(text.as_py())) is not None:
                    out.append((key.as_py(), lang.as_py(), found[0].astype(np.int32), found[1].astype(np.int32)))
            if out:
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["draw", "lang", "slots", "counts"])

    order = chosen.select(F.xxhash64("id", "text").alias("draw"), "lang", "text")
    got = order.mapInArrow(vectors, "draw long, lang string, slots array<int>, counts array<int>").toArrow()
    number = {lang: i for i, lang in enumerate(languages)}
    held = sorted(
        zip(got["draw"].to_pylist(), got["lang"].to_pylist(), got["slots"], got["counts"], strict=True), key=lambda r: (r[0], r[1])
    )
    return fit([(s.values.to_numpy(), c.values.to_numpy(), number[lang]) for _, lang, s, c in held], languages, idf)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``df``, from its text alone.

    ``und`` with score 0 where the text is null or has no letter, or where there
    was nothing to learn from.  Repeated rows give repeated results; a null id
    stays null and counts as not held out; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text.as_py() or "") for text in batch[2]]
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PREDICTED)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on ``df`` and predict every row of it."""
    return predict(df, train(df, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(
    df: DataFrame, model: Model, least: float, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``df`` whose language is known and has a score of ``least`` or more.

    Rows of ``und`` go: null texts, texts without a letter.  A null language is
    filled with the predicted one; everything else stays as it is.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text.as_py() or "") for text in batch.column(text_col)]
            keep = pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_())
            at = batch.schema.get_field_index(lang_col)
            known = batch.column(at)
            filled = pa.array([old if old is not None else lang for old, (lang, _) in zip(known.to_pylist(), found, strict=True)], known.type)
            yield batch.set_column(at, batch.schema.field(at), filled).filter(keep)

    return df.mapInArrow(run, df.schema)
