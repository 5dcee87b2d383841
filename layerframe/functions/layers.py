"""Column functions over layer arrays.  All of them are row-local built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_LAYERS

MAX_DEPTH = 1.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Spark orders NaN above every number, so ``NaN > 0`` holds; NULL does not."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def nan_layers_to_null(arr: str | Column) -> Column:
    return F.transform(_col(arr), lambda x: F.when(~F.isnan(x), x))


def pad_layers(arr: str | Column, layers: int = DEFAULT_LAYERS) -> Column:
    """Exactly ``layers`` entries: absent ones are NULL at the end.

    A present layer beyond the depth is an error: nothing is cut.
    """
    arr = F.coalesce(_col(arr), F.array().cast("array<double>"))
    padded = F.slice(F.concat(arr, F.array_repeat(F.lit(None).cast("double"), layers)), 1, layers)
    return within_depth(arr, layers, padded)


def within_depth(arr: Column, layers: int, value: Column) -> Column:
    """``value``, or an error where ``arr`` holds a present layer beyond the depth."""
    beyond = F.slice(arr, layers + 1, F.greatest(F.size(arr) - layers, F.lit(0)))
    deeper = (F.size(arr) > layers) & F.array_max(beyond).isNotNull()
    return F.when(
        deeper, F.raise_error(F.lit(f"a profile has a layer beyond depth {layers}"))
    ).otherwise(value)


def filled_to(arr: str | Column, values: Column, layers: int, fill: float | None) -> Column:
    """``values``, one per entry of ``arr``, followed by ``fill`` up to ``layers`` entries.

    Only the layers a profile has are computed; the rest is one constant array.
    """
    arr = F.coalesce(_col(arr), F.array().cast("array<double>"))
    rest = F.lit([fill] * layers).cast("array<double>")
    whole = F.slice(F.concat(F.coalesce(values, F.array().cast("array<double>")), rest), 1, layers)
    return within_depth(arr, layers, whole)


def ragged(arr: str | Column) -> Column:
    """An array without the absent layers at its end, as profiles are stored.

    Gaps inside stay; nothing present gives an empty array, whatever the depth.
    """
    arr = F.coalesce(_col(arr), F.array().cast("array<double>"))
    last = F.coalesce(F.array_max(F.transform(arr, lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0))
    return F.when(F.try_element_at(arr, F.lit(-1)).isNotNull(), arr).otherwise(F.slice(arr, 1, last))


def depth(*arrays: str | Column) -> Column:
    """Number of layers up to the last one of any of the arrays."""
    sizes = [F.coalesce(F.size(_col(a)), F.lit(0)) for a in arrays]
    return F.greatest(*sizes, F.lit(0))


def layer_presence(dz: str | Column) -> Column:
    return F.transform(_col(dz), lambda x: x.isNotNull())


def layer_count(dz: str | Column) -> Column:
    return F.coalesce(F.size(F.array_compact(_col(dz))), F.lit(0))


def layer_sum(arr: str | Column) -> Column:
    """Sum that skips absent layers; nothing present gives 0."""
    zero = F.lit(0.0)
    return F.coalesce(
        F.aggregate(_col(arr), zero, lambda acc, x: acc + F.coalesce(x, zero)), zero
    )


def thickness(dz: str | Column) -> Column:
    """Snow depth, capped at one metre."""
    return F.least(F.lit(MAX_DEPTH), layer_sum(dz))


def surface(arr: str | Column) -> Column:
    return F.get(_col(arr), F.lit(0))


def impute(arr: str | Column, value: float | Column) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.transform(_col(arr), lambda x: F.coalesce(x, value))


def zscore(arr: str | Column, mean: float, std: float) -> Column:
    """Standardise a layer array; a zero deviation yields NULL, never an error."""
    return F.transform(_col(arr), lambda x: F.try_divide(x - F.lit(mean), F.lit(std)))


def ground_first(arr: str | Column, dz: str | Column) -> Column:
    """Present layers only, ground first.  ``dz`` decides presence for every variable."""
    pairs = F.arrays_zip(_col(dz).alias("dz"), _col(arr).alias("x"))
    present = F.filter(pairs, lambda p: p["dz"].isNotNull())
    return F.reverse(F.transform(present, lambda p: p["x"]))


def running_sum(arr: str | Column) -> Column:
    """Cumulative sums of an array without leaving the row."""
    start = F.array().cast("array<double>")
    return F.aggregate(
        _col(arr),
        start,
        lambda acc, x: F.concat(
            acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)
        ),
    )


def unit_scale(arr: str | Column) -> Column:
    """Linear map of the array's own range onto 0..1 (a constant array maps to 0)."""
    arr = _col(arr)
    low, high = F.array_min(arr), F.array_max(arr)
    return F.transform(
        arr, lambda x: F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(x - low, high - low))
    )


def reshape(flat: str | Column, rows: int, cols: int) -> Column:
    """Row-major reshape of a flat vector into ``rows`` arrays of ``cols``."""
    flat = _col(flat)
    return F.array(*[F.slice(flat, r * cols + 1, cols) for r in range(rows)])


def to_float32(arr: str | Column) -> Column:
    return _col(arr).cast("array<float>")
