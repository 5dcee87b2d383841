from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe.operators import ordering, sets, splits, stats
from layerframe.operators.aggregates import check_complete, require_complete
from layerframe.operators.metrics import batch_losses, best_trial, mean_loss, mse
from layerframe.schema import LAYER_VARS, STAT_VARS
from layerframe.sources import stores

ROWS = "geo string, season string, month int, point_id long, " + ", ".join(
    f"{v} array<double>" for v in LAYER_VARS
) + ", direct_sw double, diffuse_sw double, cos_sza double, albedo double"


def make(spark, n=600, seed=0, hot=0.5, layers=4):
    """Random samples; one (geo, season, month) unit holds the ``hot`` share of them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        unit = ("Alpes", "1979_1980", 8) if i < n * hot else (
            ["Alpes", "Pyrenees"][i % 2], f"{1979 + i % 3}_{1980 + i % 3}", 1 + i % 12
        )
        arrays = [
            [None if rng.random() < 0.3 else float(1e6 + rng.normal()) for _ in range(layers)]
            for _ in LAYER_VARS
        ]
        rows.append((*unit, i, *arrays, *[float(x) for x in rng.random(4)]))
    return spark.createDataFrame(rows, ROWS).repartition(6)


def by_variable(df, column):
    return {r["variable"]: r[column] for r in df.collect()}


def test_pooled_statistics_match_numpy(spark):
    df = make(spark)
    fitted = stats.fit_stats(df)
    mean, std, n = (by_variable(fitted, c) for c in ("mean", "std", "n"))
    pdf = df.toPandas()
    for v in LAYER_VARS:
        flat = np.array([x for row in pdf[v] for x in row if x is not None], dtype=float)
        assert n[v] == len(flat)
        assert mean[v] == pytest.approx(flat.mean(), rel=1e-12)
        # 1e6 + noise: sum of squares minus squared mean would lose this deviation.
        assert std[v] == pytest.approx(flat.std(), rel=1e-6)
    assert std["albedo"] == pytest.approx(pdf["albedo"].std(ddof=0))
    assert n["albedo"] == len(pdf)


def test_merged_partials_equal_one_pass(spark):
    df = make(spark, seed=1)
    whole = stats.fit_stats(df)
    merged = stats.finish_stats(stats.merge_stats(stats.partial_stats(df)))
    for column in ("n", "mean", "std"):
        a, b = by_variable(whole, column), by_variable(merged, column)
        assert a.keys() == b.keys() == set(STAT_VARS)
        for v in a:
            assert a[v] == pytest.approx(b[v], rel=1e-9)


def test_variable_without_values_has_null_statistics(spark):
    df = make(spark, 20).withColumn("dz", F.transform("dz", lambda x: F.lit(None).cast("double")))
    row = stats.fit_stats(df).where("variable = 'dz'").first()
    assert (row["n"], row["mean"], row["std"]) == (0, None, None)


def test_norm_needs_every_variable(spark):
    with pytest.raises(ValueError):
        stats.Norm.from_stats(spark.createDataFrame([("dz", 0.0, 1.0)], "variable string, mean double, std double"))


def test_row_numbers_equal_a_global_window_when_one_unit_dominates(spark):
    df = make(spark, 3000, hot=0.9).select("geo", "season", "month", "point_id")
    order = ordering.stored_order("point_id")
    numbered = ordering.number_rows(df.repartition(7), order).collect()
    wanted = df.orderBy(*order).collect()
    got = sorted(numbered, key=lambda r: r["row_id"])
    assert [r["row_id"] for r in got] == list(range(3000))
    assert [r["point_id"] for r in got] == [r["point_id"] for r in wanted]


def test_batches_keep_the_last_short_one_and_losses_agree(spark):
    df = make(spark, 1000, hot=0.4).select("geo", "season", "month", "point_id", "albedo")
    df = df.withColumn("yhat", F.col("albedo") * 0.5)
    losses = batch_losses(ordering.assign_batches(df, 256, ordering.stored_order("point_id")))
    assert sorted(r["n"] for r in losses.collect()) == [232, 256, 256, 256]
    whole = df.agg(mse().alias("m")).first()["m"]
    assert mean_loss(losses).first()["mean_loss"] == pytest.approx(whole)
    running = ordering.running_loss(losses).orderBy("batch_id").collect()
    assert running[-1]["running_loss"] == pytest.approx(whole)
    assert running[0]["running_loss"] == pytest.approx(running[0]["loss"])


def test_running_loss_crosses_runs(spark):
    count = 3 * ordering.RUN_LENGTH + 5
    losses = spark.range(count).select(
        F.col("id").alias("batch_id"), F.lit(2).cast("long").alias("n"), F.col("id").cast("double").alias("loss")
    )
    got = ordering.running_loss(losses).orderBy("batch_id").collect()
    assert all(r["running_loss"] == pytest.approx(r["batch_id"] / 2) for r in got)


def units(spark, n):
    rows = [("Alpes", f"{1900 + i // 12}_{1901 + i // 12}", 1 + i % 12) for i in range(n)]
    return spark.createDataFrame(rows, "geo string, season string, month int")


@pytest.mark.parametrize("n,workers", [(24, 5), (24, 24), (24, 100), (25, 4)])
def test_shards_are_contiguous_and_complete(spark, n, workers):
    rows = ordering.assign_shards(units(spark, n), workers).orderBy("unit").collect()
    per = -(-n // workers)
    assert [r["shard"] for r in rows] == [i // per for i in range(n)]
    assert max(r["shard"] for r in rows) < workers


def test_ratio_split_gives_validation_the_rest(spark):
    cat = units(spark, 12 * 11)
    plan = splits.split_ratio(cat, 0.5, 0.2, None, seed=4).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in plan} == {"train": 5, "test": 2, "val": 4}
    with pytest.raises(ValueError):
        splits.split_ratio(cat, 0.8, 0.3)


def test_count_split_is_reproducible_and_disjoint(spark):
    cat = units(spark, 12 * 9)
    a = splits.train_test_split(cat, 4, 3, 1, seed=1).collect()
    assert sorted(a) == sorted(splits.train_test_split(cat, 4, 3, 1, seed=1).collect())
    assert sorted(a) != sorted(splits.train_test_split(cat, 4, 3, 1, seed=2).collect())
    assert len({(r["geo"], r["season"]) for r in a}) == 8
    with pytest.raises(ValueError):
        splits.split_counts(cat, 8, 2)


def test_explicit_split_checks_its_groups(spark):
    cat = units(spark, 24)
    one, two = ("Alpes", "1900_1901"), ("Alpes", "1901_1902")
    assert splits.train_test_split(cat, {one}, {two}).count() == 2
    with pytest.raises(ValueError, match="share groups"):
        splits.train_test_split(cat, {one}, {one})
    with pytest.raises(ValueError, match="catalog"):
        splits.train_test_split(cat, {one}, {("Alpes", "1950_1951")})
    with pytest.raises(TypeError):
        splits.train_test_split(cat, {one}, 2)


def test_single_group_ratio(spark):
    plan = splits.split_ratio(units(spark, 12), 0.7, 0.2, 0.1).collect()
    assert [r["split"] for r in plan] == ["val"]


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (1,)], "x int")
    c = spark.createDataFrame([(3,)], "x int")
    assert sets.same_inputs(a, b) and not sets.same_inputs(a, c)
    sets.assert_disjoint(train=a, test=c)
    with pytest.raises(ValueError, match="train and test"):
        sets.assert_disjoint(train=a, test=b)
    assert sets.union_all([a, b]).count() == 5


def test_completeness(spark):
    cat = units(spark, 23)
    assert [tuple(r) for r in check_complete(cat).collect()] == [("Alpes", "1901_1902", 11)]
    with pytest.raises(ValueError, match="twelve months"):
        require_complete(cat)
    require_complete(units(spark, 24))


def test_best_trial(spark):
    df = spark.createDataFrame([(0, 0.1, 3.0), (1, 0.2, 1.0), (2, 0.3, 2.0)], "trial int, rate double, value double")
    assert tuple(best_trial(df).first()) == (1, 0.2, 1.0)


def test_refresh_reuses_stored_partials(spark, tmp_path):
    path = str(tmp_path / "stats")
    df = make(spark, 400, seed=2)
    part = df.where("season = '1979_1980'")
    assert stores.refresh_stats(part, path) is True
    assert stores.refresh_stats(part, path) is False
    assert stores.refresh_stats(df, path) is True
    fitted, inputs = stores.load_stats(spark, path)
    want = by_variable(stats.fit_stats(df), "std")
    for v, value in by_variable(fitted, "std").items():
        assert value == pytest.approx(want[v], rel=1e-9)
    assert {r["season"] for r in inputs.collect()} == {"1979_1980", "1980_1981", "1981_1982"}
    # Back to the smaller selection: nothing is scanned, the result shrinks again.
    assert stores.refresh_stats(part, path) is True
    n = by_variable(stores.load_stats(spark, path)[0], "n")
    assert n["albedo"] == part.count()


def test_refresh_notices_a_group_that_grew(spark, tmp_path):
    path = str(tmp_path / "stats")
    df = make(spark, 100, seed=3)
    stores.refresh_stats(df.where("point_id >= 40"), path)
    assert stores.refresh_stats(df, path) is True
    assert by_variable(stores.load_stats(spark, path)[0], "n")["albedo"] == 100


def test_refresh_notices_new_values_in_as_many_rows(spark, tmp_path):
    path = str(tmp_path / "stats")
    df = make(spark, 100, seed=3)
    stores.refresh_stats(df, path)
    assert stores.refresh_stats(df.repartition(7), path) is False
    changed = df.withColumn("albedo", F.col("albedo") / 2)
    assert stores.refresh_stats(changed, path) is True
    want = by_variable(stats.fit_stats(changed), "mean")["albedo"]
    assert by_variable(stores.load_stats(spark, path)[0], "mean")["albedo"] == pytest.approx(want)


def test_feature_cache_follows_keys_and_content(spark, tmp_path):
    path = str(tmp_path / "features")
    df = make(spark, 60, seed=5)
    norm = stats.Norm.from_stats(stats.fit_stats(df))
    assert "point_id" in stores.cached_features(df, norm, path, ("point_id",), 4).columns
    assert "geo" in stores.cached_features(df, norm, path, ("geo", "point_id"), 4).columns
    halved = df.withColumn("albedo", F.col("albedo") / 2)
    built = stores.cached_features(halved, norm, path, ("geo", "point_id"), 4)
    assert sorted(r["y"] for r in built.collect()) == pytest.approx(sorted(r["albedo"] for r in halved.collect()), rel=1e-6)


def test_published_layout_of_statistics(spark):
    fitted = stats.fit_stats(make(spark, 80, seed=6))
    wide = stats.stats_to_wide(fitted)
    assert wide.columns == ["statistic", *STAT_VARS] and wide.count() == 2
    assert stats.Norm.from_wide(wide) == stats.Norm.from_stats(stats.stats_from_wide(wide))
    assert stats.Norm.from_wide(wide).mean == pytest.approx(stats.Norm.from_stats(fitted).mean)
    with pytest.raises(ValueError):
        stats.Norm.from_wide(wide.where("statistic = 'mean'"))


def test_feature_cache_is_rebuilt_when_its_inputs_change(spark, tmp_path):
    path = str(tmp_path / "features")
    df = make(spark, 120, seed=4)
    norm = stats.Norm.from_stats(stats.fit_stats(df))
    keys = ("point_id",)
    assert stores.cached_features(df.where("month <> 8"), norm, path, keys, 4).count() < 120
    assert stores.cached_features(df, norm, path, keys, 4).count() == 120
    mark = spark.read.parquet(f"{path}/features").inputFiles()
    stores.cached_features(df, norm, path, keys, 4)
    assert spark.read.parquet(f"{path}/features").inputFiles() == mark
    stores.cached_features(df, norm, path, keys, 4, force_rebuild=True)
    assert spark.read.parquet(f"{path}/features").inputFiles() != mark
