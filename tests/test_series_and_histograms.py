from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe.functions.times import DAY, HOUR
from layerframe.operators import histograms, series

START = datetime(1980, 2, 1)


def filled_by_hand(times, step):
    """The rule in words: walk the samples, add a step while the next one is too far."""
    out = [times[0]]
    for t in times[1:]:
        while t - out[-1] > step:
            out.append(out[-1] + step)
        out.append(t)
    return out


@pytest.mark.parametrize("step", [HOUR, DAY])
def test_gap_filling_equals_the_walk(spark, step):
    rng = random.Random(3)
    rows, wanted = [], []
    for key in range(40):
        minutes = sorted({rng.randrange(0, 6000) for _ in range(rng.randrange(1, 60))})
        scale = step / HOUR
        stamps = [START + timedelta(minutes=m * scale) for m in minutes]
        rows += [(key, t, 1.0) for t in stamps]
        wanted += [(key, t) for t in filled_by_hand(stamps, step)]
    df = spark.createDataFrame(rows, "key int, time timestamp_ntz, value double")
    got = series.fill_gaps(df, "time", step, ["key"])
    assert sorted((r["key"], r["time"]) for r in got.collect()) == sorted(wanted)
    assert got.where("value is null").count() == len(wanted) - len(rows)


def test_gap_of_exactly_one_step_needs_no_filler(spark):
    df = spark.createDataFrame(
        [(START,), (START + HOUR,), (START + 3 * HOUR,)], "time timestamp_ntz"
    )
    got = sorted(r["time"] for r in series.fill_gaps(df, "time", HOUR).collect())
    assert got == [START + k * HOUR for k in range(4)]


def test_many_samples_at_one_time_stay_one_slot(spark):
    crowd = [(1, START)] * 500 + [(1, START + 2 * HOUR)]
    df = spark.createDataFrame(crowd, "key int, time timestamp_ntz")
    assert series.fillers(df, "time", HOUR, ["key"]).collect()[0]["time"] == START + HOUR
    assert series.fill_gaps(df, "time", HOUR, ["key"]).count() == 502


def test_resampling_lists_empty_months(spark):
    rows = [(1, datetime(1980, 1, 31, 23), 2.0), (1, datetime(1980, 4, 1), None), (2, START, 5.0)]
    df = spark.createDataFrame(rows, "key int, time timestamp_ntz, x double")
    got = series.resample_sum(df, "time", ["x"], ["key"]).orderBy("key", "month").collect()
    assert [(r["key"], r["month"].month, r["x"]) for r in got] == [
        (1, 1, 2.0), (1, 2, 0.0), (1, 3, 0.0), (1, 4, 0.0), (2, 2, 5.0),
    ]


def test_histogram_matches_numpy_on_edges_and_inside(spark):
    rng = np.random.default_rng(5)
    edges = np.linspace(0, 0.99, 201)
    values = np.concatenate([edges, rng.uniform(-0.1, 1.1, 3000), np.nextafter(edges, -1)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = histograms.histogram(df, "x", 200, 0, 0.99).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram(values, 200, (0, 0.99))[0].tolist()
    assert got[-1]["count"] >= 1, "0.99 itself belongs to the last bin"


def test_log_histogram_matches_numpy(spark):
    edges = np.logspace(-21, 0, 200)
    values = np.concatenate([edges, [0.0, 2.0, 1e-22], 10 ** np.random.default_rng(1).uniform(-22, 1, 2000)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = histograms.log_histogram(df, "x", -21, 0, 200).orderBy("bin").collect()
    assert len(got) == 199
    assert [r["count"] for r in got] == np.histogram(values, edges)[0].tolist()


def test_automatic_range_and_constant_column(spark):
    values = np.random.default_rng(2).normal(size=1000)
    df = spark.createDataFrame([(float(v), 3.0) for v in values], "x double, c double")
    got = histograms.histogram(df, ["x", "c"], 50).orderBy("variable", "bin").collect()
    by = {v: [r["count"] for r in got if r["variable"] == v] for v in ("x", "c")}
    assert by["x"] == np.histogram(values, 50)[0].tolist()
    assert by["c"] == np.histogram(np.full(1000, 3.0), 50)[0].tolist()


def test_missing_values_are_in_no_bin(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,)], "x double")
    assert histograms.histogram(df, "x", 10, 0, 1).agg(F.sum("count")).first()[0] == 1
