"""Train, test and validation plans over whole (geo, season) groups."""

from __future__ import annotations

from decimal import Decimal
from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import GROUP_COLS
from .ordering import shuffle_units

TYPES = "train, test and val must all be sets, all integers or all floats"
PLAN_SCHEMA = "geo string, season string, split string"
Group = tuple[str, str]


def _groups(catalog: DataFrame) -> DataFrame:
    """The stored groups, held as a local table so the catalog is scanned once."""
    return catalog.select(*GROUP_COLS).distinct()


def split_explicit(
    catalog: DataFrame, train: set[Group], test: set[Group], val: set[Group] | None = None
) -> DataFrame:
    """Plan from named groups: they must not overlap and must all be stored."""
    named = {"train": set(train), "test": set(test), "val": set(val or ())}
    for a, b in (("train", "test"), ("train", "val"), ("test", "val")):
        if named[a] & named[b]:
            raise ValueError(f"{a} and {b} share groups: {sorted(named[a] & named[b])}")
    rows = [(geo, season, name) for name, groups in named.items() for geo, season in sorted(groups)]
    plan = catalog.sparkSession.createDataFrame(rows, PLAN_SCHEMA)
    unknown = plan.join(_groups(catalog), GROUP_COLS, "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"not in the catalog: {[(r['geo'], r['season']) for r in unknown]}")
    return plan


def _by_position(groups: DataFrame, seed: int | None, train: int, test: int, val: int) -> DataFrame:
    # The catalog has one row per stored season: one window over it is enough.
    shuffled = shuffle_units(groups, 0 if seed is None else seed)
    place = F.row_number().over(W.orderBy("digest", *GROUP_COLS))
    label = (
        F.when(F.col("place") <= train, "train")
        .when(F.col("place") <= train + test, "test")
        .when(F.col("place") <= train + test + val, "val")
    )
    ranked = shuffled.withColumn("place", place).withColumn("split", label)
    return ranked.where(F.col("split").isNotNull()).select(*GROUP_COLS, "split")


def split_counts(
    catalog: DataFrame, train: int, test: int, val: int | None = None, seed: int | None = None
) -> DataFrame:
    """Plan with the given numbers of groups in a seeded random order."""
    groups = _groups(catalog)
    total, asked = groups.count(), train + test + (val or 0)
    if asked > total:
        raise ValueError(f"{asked} groups requested, {total} available")
    return _by_position(groups, seed, train, test, val or 0)


def split_ratio(
    catalog: DataFrame, train: float, test: float, val: float | None = None, seed: int | None = None
) -> DataFrame:
    """Plan by shares.  Train and test round down; validation takes all the rest."""
    if Decimal(str(train)) + Decimal(str(test)) + Decimal(str(val or 0)) > 1:
        raise ValueError("the shares add up to more than 1")
    groups = _groups(catalog)
    total = groups.count()
    n_train, n_test = floor(train * total), floor(test * total)
    return _by_position(groups, seed, n_train, n_test, total - n_train - n_test)


def train_test_split(
    catalog: DataFrame, train, test, val=None, seed: int | None = None
) -> DataFrame:
    """Pick the kind of plan from the type of the arguments."""
    given = [a for a in (train, test, val) if a is not None]
    if any(isinstance(a, bool) for a in given):
        raise TypeError(TYPES)
    if all(isinstance(a, (set, frozenset)) for a in given):
        return split_explicit(catalog, train, test, val)
    if all(isinstance(a, int) for a in given):
        return split_counts(catalog, train, test, val, seed)
    if all(isinstance(a, float) for a in given):
        return split_ratio(catalog, train, test, val, seed)
    raise TypeError(TYPES)
