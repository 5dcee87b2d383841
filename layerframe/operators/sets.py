"""Set operations on tables, times and splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; duplicates stay."""
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b), frames)


def common_times(a: DataFrame, b: DataFrame, ts: str = "time") -> DataFrame:
    """Sorted distinct times present in both tables."""
    return a.select(ts).intersect(b.select(ts)).orderBy(ts)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def assert_disjoint(**sets: DataFrame) -> None:
    """Raise when any two of the named sets share a row."""
    for (left, a), (right, b) in combinations(sets.items(), 2):
        if not overlap(a, b).isEmpty():
            raise ValueError(f"{left} and {right} share rows")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows found in one set only, whichever it is."""
    b = b.select(*a.columns)
    return a.subtract(b).unionByName(b.subtract(a))


def same_inputs(a: DataFrame, b: DataFrame) -> bool:
    """Equality as sets: order and repetition do not matter."""
    return difference(a, b).isEmpty()
