from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerframe.functions import clustering, names
from layerframe.operators import joins, ordering, splits
from layerframe.operators.aggregates import check_complete, time_coverage, value_range
from layerframe.operators.features import build_features
from layerframe.operators.filters import at_site, clean_missing
from layerframe.operators.histograms import histogram
from layerframe.operators.stats import Norm, fit_stats
from layerframe.plans.evaluation import fit_stored_norm
from layerframe.plans.ingest import STORED_KEY, build_samples, ingest, to_sample_table
from layerframe.schema import LAYER_VARS, LOG_CURRENT, LOG_FOUR_METRICS, LOG_SHORT, STAT_VARS, UNIT_COLS
from layerframe.session import co_partitioned, materialise, scratch, scratch_path
from layerframe.sources import inputs, ledger, logs, samples, stores
from tests.conftest import plan_of

NAN = float("nan")


def raw(spark, seasons=("1979_1980", "1980_1981")):
    """Four hours at three points per season; point 3 has no snow, hour 0 is night."""
    forcing, profile = [], []
    for geo in ("Alpes", "Pyrenees"):
        for season in seasons:
            y1 = int(season[:4])
            for month, year in ((8, y1), (2, y1 + 1)):
                for hour in range(4):
                    at = datetime(year, month, 1, hour)
                    for point in (1, 2, 3):
                        light = 0.0 if hour == 0 else 100.0 + hour
                        forcing.append((at, point, light, NAN if hour == 0 else 5.0, geo, season))
                        for patch in (0, 1):
                            swe = NAN if point == 3 else 10.0 + patch
                            stack = [[0.1 * point, 0.2, NAN]] + [[1.0, 2.0, NAN]] * 4
                            profile.append((at, point, patch, swe, 0.8, *stack, geo, season))
    arrays = ", ".join(f"{v} array<double>" for v in LAYER_VARS)
    return (
        spark.createDataFrame(forcing, "time timestamp_ntz, point_id long, direct_sw double, diffuse_sw double, geo string, season string"),
        spark.createDataFrame(profile, f"time timestamp_ntz, point_id long, patch int, swe double, albedo double, {arrays}, geo string, season string"),
    )


def points(spark):
    rows = [(p, 3, 2700.0, -1.0, 0.0, 45.0, 6.0) for p in (1, 2, 3)]
    return spark.createDataFrame(
        rows, "point_id long, massif_number int, zs double, aspect double, slope double, lat double, lon double"
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("ingest"))
    forcing, profile = raw(spark)
    inputs.write_inputs(forcing, profile, f"{base}/in")
    ingest(spark, f"{base}/in", points(spark), f"{base}/out")
    return f"{base}/out"




def test_build_keeps_day_and_snow_of_the_first_patch(spark):
    forcing, profile = raw(spark)
    built = build_samples(forcing, profile, points(spark), STORED_KEY)
    assert built.count() == 2 * 2 * 2 * 3 * 2
    row = built.where("point_id = 2").first()
    assert row["dz"] == [0.2, 0.2]
    assert (row["n_layers"], row["swe"], row["surface_ssa"]) == (2, 10.0, 1.0)
    assert row["thickness"] == pytest.approx(0.4)
    assert -1 <= row["cos_sza"] <= 1


def test_missing_input_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        inputs.read_inputs(spark, str(tmp_path))


def test_pairing(spark):
    rows = [("Alpes", "FORCING_1979080106_1980080106.nc"), ("Alpes", "PRO_1979080106_1980080106.nc"),
            ("Pyrenees", "FORCING_1979080106_1980080106.nc")]
    pairs = inputs.pair_inputs(spark.createDataFrame(rows, "geo string, name string"))
    assert {(r["geo"], r["season"], r["profile"]) for r in pairs.collect()} == {
        ("Alpes", "1979_1980", "PRO_1979080106_1980080106.nc"), ("Pyrenees", "1979_1980", None),
    }
    with pytest.raises(FileNotFoundError, match="no profile"):
        inputs.require_pairs(pairs)
    with pytest.raises(FileNotFoundError, match="empty"):
        inputs.require_pairs(pairs.where("geo = 'x'"))


def test_season_names(spark):
    df = spark.createDataFrame([("1979_1980",), ("1979_1981",), ("79_80",), ("abcd_efgh",)], "s string")
    assert [bool(r[0]) for r in df.select(names.is_season("s")).collect()] == [True, False, False, False]


def test_stored_layout_and_catalog(spark, stored):
    table = samples.read_samples(spark, stored)
    assert {r["n"] for r in samples.scan_units(table).collect()} == {6}
    assert samples.scan_units(table).count() == 8
    by_season = samples.catalog(table, "season").collect()
    assert all(r["months"] == [8, 2] for r in by_season), "season order, not calendar order"
    by_geo = {r["geo"]: [s["season"] for s in r["seasons"]] for r in samples.catalog(table, "geo").collect()}
    assert by_geo == {g: ["1979_1980", "1980_1981"] for g in ("Alpes", "Pyrenees")}
    with pytest.raises(ValueError):
        samples.catalog(table, "planet")
    assert samples.labels_of(spark.read.parquet(f"{stored}/data"))["albedo"] == "snow albedo"


def test_reading_one_season_checks_its_arguments(spark, stored):
    assert samples.read_season(spark, stored, "Alpes", "1979_1980").count() > 0
    for geo, season in (("Jura", "1979_1980"), ("Alpes", "1979-1980"), ("Alpes", "1999_2000")):
        with pytest.raises(ValueError):
            samples.read_season(spark, stored, geo, season)


UNITS_AND_ZS = "geo string, season string, month int, zs double"


def read_zs(spark, root):
    schema = T.StructType.fromDDL(UNITS_AND_ZS)
    return samples.read_samples(spark, root, schema)


def test_rewriting_a_season_drops_its_stale_months_only(spark, tmp_path):
    root = str(tmp_path / "samples")
    rows = [("Alpes", s, m, m * 1.0) for s in ("1979_1980", "1980_1981") for m in (8, 9, 10)]
    df = spark.createDataFrame(rows, UNITS_AND_ZS)
    samples.write_samples(df, root)
    before = read_zs(spark, root)
    samples.write_samples(df.where("season = '1979_1980' and month = 9").withColumn("zs", F.lit(0.0)), root)
    left = {(r["season"], r["month"], r["zs"]) for r in read_zs(spark, root).collect()}
    assert left == {("1979_1980", 9, 0.0), *[("1980_1981", m, m * 1.0) for m in (8, 9, 10)]}
    assert before.count() == 6, "a reader keeps the commits it started with"


def test_folder_names_with_special_characters(spark, tmp_path):
    root = str(tmp_path / "samples")
    names = ["Massif Central", "a=b/c", "50%", "Écrins:2 'x'"]
    df = spark.createDataFrame([(g, "1979_1980", m, 1.0) for g in names for m in (8, 9)], UNITS_AND_ZS)
    samples.write_samples(df, root)
    samples.write_samples(df.where("month = 8"), root)
    assert sorted((r["geo"], r["month"]) for r in read_zs(spark, root).collect()) == sorted((g, 8) for g in names)
    assert ledger.forget(spark, root) == 1
    assert read_zs(spark, root).count() == 4
    assert ledger.forget(spark, root) == 1 and read_zs(spark, root).count() == 4


def test_two_writers_on_different_seasons_both_survive(spark, tmp_path):
    root = str(tmp_path / "samples")
    rows = [("Alpes", s, m, m * 1.0) for s in ("1979_1980", "1980_1981") for m in (8, 9)]
    df = spark.createDataFrame(rows, UNITS_AND_ZS)
    samples.write_samples(df, root)
    # both start from the same ledger, and end in either order
    version = ledger.next_version(spark, root)
    writers = []
    for season in ("1979_1980", "1980_1981"):
        part = df.where((F.col("season") == season) & (F.col("month") == 8)).withColumn("zs", F.lit(-1.0))
        commit = ledger.new_commit()
        part.write.partitionBy("geo", "season", "month").parquet(ledger.commit_folder(root, commit))
        writers.append((part, commit))
    for part, commit in reversed(writers):
        assert read_zs(spark, root).where("zs > 0").count() > 0, "nothing is visible before its ledger row"
        ledger.append(ledger.summarise(part), root, version, commit)
    assert {tuple(r) for r in read_zs(spark, root).collect()} == {
        ("Alpes", s, 8, -1.0) for s in ("1979_1980", "1980_1981")
    }


def test_a_write_that_never_reached_the_ledger_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "samples")
    df = spark.createDataFrame([("Alpes", "1979_1980", 8, 1.0)], UNITS_AND_ZS)
    samples.write_samples(df, root)
    df.withColumn("zs", F.lit(2.0)).write.partitionBy("geo", "season", "month").parquet(ledger.commit_folder(root, "lost"))
    assert [r["zs"] for r in read_zs(spark, root).collect()] == [1.0]
    with pytest.raises(FileNotFoundError):
        samples.read_samples(spark, str(tmp_path / "nowhere"))
    samples.write_samples(df.limit(0), str(tmp_path / "empty"))
    assert read_zs(spark, str(tmp_path / "empty")).count() == 0


def test_the_ledger_knows_its_units(spark, stored):
    table, held = samples.read_samples(spark, stored), ledger.units(spark, stored)
    by_unit = {tuple(r[c] for c in UNIT_COLS): r for r in held.collect()}
    assert {k: r["n"] for k, r in by_unit.items()} == {tuple(r[c] for c in UNIT_COLS): r["n"] for r in samples.scan_units(table).collect()}
    assert sorted(ledger.unit_sizes(held).collect()) == sorted(samples.scan_units(table).collect())
    assert sorted(ledger.coverage(held).collect()) == sorted(time_coverage(table).collect())
    for column in ("albedo", "surface_ssa", "zs", "n_layers"):
        want = value_range(table.withColumn(column, F.col(column).cast("double")), column, ["geo"])
        assert sorted(ledger.stored_range(held, column, ["geo"]).collect()) == sorted(want.collect())
    assert ledger.deepest(held) == 2
    digests = {k: r["digest"] for k, r in by_unit.items()}
    for r in table.groupBy(*UNIT_COLS).agg(stores.content(table).alias("content")).collect():
        assert digests[tuple(r[c] for c in UNIT_COLS)] == r["content"]


def test_statistics_of_the_ledger_equal_a_scan(spark, stored, tmp_path):
    path, table = str(tmp_path / "stats"), samples.read_samples(spark, stored)
    with pytest.raises(ValueError, match="without twelve months"):
        stores.refresh_stored_stats(spark, stored, path)
    assert stores.refresh_stored_stats(spark, stored, path, complete=False) is True
    assert stores.refresh_stored_stats(spark, stored, path, complete=False) is False
    got = {r["variable"]: r for r in stores.load_stats(spark, path)[0].collect()}
    for r in fit_stats(table).collect():
        mine = got[r["variable"]]
        assert mine["n"] == r["n"]
        assert [mine["mean"], mine["std"]] == (pytest.approx([r["mean"], r["std"]], abs=1e-12) if r["n"] else [None, None])
    plan = samples.catalog(ledger.units(spark, stored)).where("geo = 'Alpes'")
    assert stores.refresh_stored_stats(spark, stored, path, plan, complete=False) is True
    n = {r["variable"]: r["n"] for r in stores.load_stats(spark, path)[0].collect()}
    assert n["albedo"] == table.where("geo = 'Alpes'").count()
    norm = fit_stored_norm(spark, stored, plan.select("geo", "season").distinct().withColumn("split", F.lit("train")))
    assert norm.mean["albedo"] == pytest.approx(0.8)


def test_rewriting_equal_rows_does_not_refit(spark, stored, tmp_path):
    root, path = str(tmp_path / "copy"), str(tmp_path / "stats")
    table = samples.read_samples(spark, stored)
    samples.write_samples(table, root)
    assert stores.refresh_stored_stats(spark, root, path, complete=False) is True
    samples.write_samples(table.where("season = '1979_1980'").repartition(5), root)
    assert stores.refresh_stored_stats(spark, root, path, complete=False) is False
    samples.write_samples(table.where("season = '1979_1980'").withColumn("albedo", F.lit(0.1)), root)
    assert stores.refresh_stored_stats(spark, root, path, complete=False) is True


def scans(df, root):
    """Files of the table itself that a plan reads."""
    return [f for f in df.inputFiles() if f"{root}/data" in f.replace("file://", "")]


def test_catalogues_and_plans_read_the_ledger_only(spark, stored):
    held = ledger.units(spark, stored)
    for df in (
        samples.catalog(held), samples.catalog(held, "season"), samples.catalog(held, "geo"), samples.describe_selection(held),
        ledger.unit_sizes(held), ledger.coverage(held), ledger.stored_range(held, "albedo"), check_complete(samples.catalog(held)),
        splits.train_test_split(samples.catalog(held), 0.5, 0.25, seed=1), splits.train_test_split(samples.catalog(held), 1, 1, seed=1),
        splits.train_test_split(samples.catalog(held), {("Alpes", "1979_1980")}, {("Pyrenees", "1979_1980")}),
    ):
        assert df.count() >= 0 and not scans(df, stored)


def test_one_season_lists_its_own_folder_only(spark, stored):
    files = scans(samples.read_season(spark, stored, "Alpes", "1979_1980"), stored)
    assert files and all("geo=Alpes/season=1979_1980" in f for f in files)


def test_an_automatic_range_costs_no_scan(spark, stored):
    table, held = samples.read_samples(spark, stored), ledger.units(spark, stored)
    columns = ["albedo", "surface_ssa"]
    known = histogram(table, columns, 10, ends=ledger.stored_spans(held, columns))
    assert plan_of(known).count("FileScan") == 1
    assert sorted(known.collect()) == sorted(histogram(table, columns, 10).collect())


def feature_view(spark, root, path, norm, keys=("time", "point_id")):
    built = stores.refresh_features(spark, root, path, norm, keys, 5)
    return built, stores.read_features(spark, path, stores.feature_schema(keys))


def test_only_changed_units_are_rebuilt(spark, stored, tmp_path):
    root, path = str(tmp_path / "copy"), str(tmp_path / "features")
    table = samples.read_samples(spark, stored)
    samples.write_samples(table, root)
    norm = Norm({v: 0.0 for v in STAT_VARS}, {v: 1.0 for v in STAT_VARS})
    built, view = feature_view(spark, root, path, norm)
    assert built == 8 and view.count() == table.count()
    files = set(view.inputFiles())
    assert feature_view(spark, root, path, norm)[0] == 0
    # equal rows in a new commit: nothing to do
    samples.write_samples(table.where("season = '1979_1980'"), root)
    assert feature_view(spark, root, path, norm)[0] == 0
    # one unit changes, another goes
    changed = table.where("geo = 'Alpes' and season = '1980_1981' and month = 8").withColumn("albedo", F.lit(0.25))
    samples.write_samples(changed, root)
    built, view = feature_view(spark, root, path, norm)
    assert built == 1
    kept = {f for f in files if "geo=Alpes/season=1980_1981" not in f}
    assert kept < set(view.inputFiles()) and len(set(view.inputFiles()) - files) >= 1
    want = build_features(samples.read_samples(spark, root), norm, ("time", "point_id", *UNIT_COLS), 5)
    order = ["geo", "season", "month", "time", "point_id"]
    assert view.orderBy(*order).select(*want.columns).collect() == want.orderBy(*order).collect()
    # another recipe rebuilds everything
    assert feature_view(spark, root, path, Norm(norm.mean, {v: 2.0 for v in STAT_VARS}))[0] == 7


def test_deep_profiles_are_stored_and_read(spark, tmp_path):
    root = str(tmp_path / "deep")
    forcing, profile = raw(spark)
    stack = F.array(*[F.lit(0.01)] * 60)
    built = build_samples(forcing, profile.withColumns({v: stack for v in LAYER_VARS}), points(spark), STORED_KEY)
    samples.write_samples(to_sample_table(built), root)
    held = ledger.units(spark, root)
    assert ledger.deepest(held) == 60
    assert {len(r["dz"]) for r in samples.read_samples(spark, root).select("dz").collect()} == {60}
    n = {r["variable"]: r["n"] for r in fit_stats(samples.read_samples(spark, root)).collect()}
    assert n["dz"] == 60 * n["albedo"]


def test_log_shapes(spark, tmp_path):
    paths = []
    for k, schema in enumerate((LOG_CURRENT, LOG_FOUR_METRICS, LOG_SHORT)):
        row = [tuple([k + 1, *[0.5] * (len(schema) - 1)])]
        paths.append(str(tmp_path / f"log{k}"))
        logs.append_log(spark.createDataFrame(row, schema), paths[-1], fresh=True)
    logs.append_log(spark.createDataFrame([(9, 0.1, 0.2)], LOG_SHORT), paths[-1])
    got = logs.read_logs(spark, paths).collect()
    assert sorted((r["log_shape"], r["epoch"]) for r in got) == [
        ("current", 1), ("four_metrics", 2), ("short", 3), ("short", 9),
    ]
    logs.append_log(spark.createDataFrame([(1, 0.1, 0.2)], LOG_SHORT), paths[-1], fresh=True)
    assert logs.read_log(spark, paths[-1]).count() == 1
    bad = str(tmp_path / "bad")
    spark.createDataFrame([(1,)], "x int").write.option("header", True).csv(bad)
    with pytest.raises(ValueError):
        logs.read_log(spark, bad)


def test_a_folder_of_logs_in_any_shape(spark, tmp_path):
    root = tmp_path / "all logs"
    (root / "deep").mkdir(parents=True)
    (root / "one.csv").write_text("epoch,loss,metric\r\n1,0.5,0.25\r\n2,,0.125\r\n")
    (root / "deep" / "two.csv").write_text("epoch,learning_rate,train_loss,train_metric,test_loss,test_metric\n7,0.1,1,2,3,4")
    (root / "empty.csv").write_text("")
    (root / "header.csv").write_text("epoch,loss,metric\n")
    got = logs.read_log_folder(spark, str(root)).collect()
    assert {(r["log"], r["epoch"], r["loss"], r["test_metric"]) for r in got} == {
        ("one.csv", 1, 0.5, None), ("one.csv", 2, None, None), ("deep/two.csv", 7, None, 4.0),
    }
    assert {r["log_shape"] for r in got} == {"short", "current"}
    (root / "bad.csv").write_text("epoch,metric,loss\n1,2,3\n")
    with pytest.raises(Exception, match="unknown log header"):
        logs.read_log_folder(spark, str(root)).collect()


def test_a_log_with_columns_in_another_order_is_an_error(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(spark.createDataFrame([(1, 0.8, 0.9)], "epoch long, loss double, metric double"), path, fresh=True)
    logs.append_log(spark.createDataFrame([(2, 0.9, 0.8)], "epoch long, metric double, loss double"), path)
    with pytest.raises(Exception):
        logs.read_log(spark, path).collect()


def stored_raw(spark, tmp_path, forcing=None, profile=None):
    first, second = raw(spark)
    inputs.write_inputs(forcing or first, profile or second, str(tmp_path / "in"))
    return str(tmp_path / "in"), str(tmp_path / "out")


def test_ingest_needs_both_sides_of_a_season(spark, tmp_path):
    forcing, profile = raw(spark)
    season = forcing.select("season").distinct().first()["season"]
    paths = stored_raw(spark, tmp_path, profile=profile.where(F.col("season") != season))
    with pytest.raises(FileNotFoundError, match=season):
        ingest(spark, paths[0], points(spark), paths[1])


def test_ingest_refuses_repeated_keys(spark, tmp_path):
    forcing, _ = raw(spark)
    paths = stored_raw(spark, tmp_path, forcing=forcing.union(forcing.limit(1)))
    with pytest.raises(ValueError, match="forcing rows repeat"):
        ingest(spark, paths[0], points(spark), paths[1])


def test_ingest_keeps_a_manifest(spark, tmp_path):
    paths = stored_raw(spark, tmp_path)
    ingest(spark, paths[0], points(spark), paths[1], run={"id": "a"})
    row = samples.read_manifest(spark, paths[1]).first()
    table = samples.read_samples(spark, paths[1])
    assert row["n"] == table.count() and row["run"] == {"id": "a"} and row["resolution"] > 0


# --- the shape of the plans ---

def test_site_filters_reach_the_scan(spark, stored):
    df = at_site(samples.read_samples(spark, stored), 3, 2700, 0, -1).where(
        (F.col("surface_ssa") <= 20) & (F.col("season") == "1979_1980")
    ).select("time", "albedo")
    plan = plan_of(df)
    assert "EqualTo(massif_number,3)" in plan and "LessThanOrEqual(surface_ssa,20.0)" in plan
    assert "PartitionFilters: [isnotnull(season" in plan
    scan = plan[plan.index("ReadSchema"):]
    assert "dz" not in scan.splitlines()[0] and "density" not in scan.splitlines()[0]


def test_counting_units_reads_no_column(spark, stored):
    assert "ReadSchema: struct<>" in plan_of(samples.scan_units(samples.read_samples(spark, stored)))


def test_ingest_filters_reach_both_scans(spark, tmp_path):
    forcing, profile = raw(spark)
    inputs.write_inputs(forcing, profile, str(tmp_path))
    stored = inputs.read_inputs(spark, str(tmp_path), clean=False)
    plan = plan_of(to_sample_table(build_samples(*stored, points(spark), STORED_KEY)))
    assert "GreaterThan(swe,0.0)" in plan and "EqualTo(patch,0)" in plan
    assert "Or(GreaterThan(direct_sw,0.0),GreaterThan(diffuse_sw,0.0))" in plan
    assert "imp_dry1" not in plan, "unused inputs are not read"


def test_bucketed_inputs_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = spark.conf.get("spark.sql.warehouse.dir")
    try:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}'")
        tables = ("bucketed.forcing", "bucketed.profile")
        inputs.write_bucketed_inputs(*raw(spark), tables, 4)
        with co_partitioned(spark):
            built = build_samples(*[spark.table(t) for t in tables], F.broadcast(points(spark)), STORED_KEY)
            plan = plan_of(built)
            assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
            assert built.count() == 2 * 2 * 2 * 3 * 2
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE IF EXISTS bucketed CASCADE")
    assert spark.conf.get("spark.sql.warehouse.dir") == before


def test_statistics_take_one_shuffle_and_one_scan(spark, stored):
    plan = plan_of(fit_stats(samples.read_samples(spark, stored)))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_writing_rebalances_on_the_unit(spark):
    df = spark.createDataFrame([("Alpes", "1979_1980", 8)], "geo string, season string, month int")
    hinted = df.hint("rebalance", "geo", "season", "month")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan_of(hinted)


def test_a_unit_that_dominates_becomes_many_files(spark, tmp_path):
    root = str(tmp_path / "hot")
    df = spark.range(200_000, numPartitions=6).select(
        F.lit("Alpes").alias("geo"), F.lit("1979_1980").alias("season"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 1).otherwise(8).cast("int").alias("month"),
        F.rand(1).alias("zs"), F.rand(2).alias("slope"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        samples.write_samples(df, root)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = samples.read_samples(spark, root, df.schema)
    files = [f for f in stored.inputFiles() if "month=8/" in f]
    assert len(files) >= 4, "the hot unit was written by several tasks"
    assert stored.count() == 200_000


def test_a_row_of_an_unlisted_point_is_an_error(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 6.0)], "point_id long, x double")
    listed = spark.createDataFrame([(1, 100.0), (2, 200.0)], "point_id long, zs double")
    got = joins.with_point_attrs(rows, listed)
    assert sorted((r["point_id"], r["zs"]) for r in got.collect()) == [(1, 100.0), (2, 200.0)]
    with pytest.raises(Exception, match="no such point: 2"):
        joins.with_point_attrs(rows, listed.where("point_id = 1")).select("x").collect()


def test_row_numbers_need_no_global_sort_task(spark):
    df = spark.range(1000).withColumn("month", F.lit(8))
    plan = plan_of(ordering.number_rows(df, [F.col("id")]))
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_duplicate_keys_are_reported(spark):
    rows = [(datetime(1980, 1, 1), 1), (datetime(1980, 1, 1), 1), (datetime(1980, 1, 1), 2)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, point_id long")
    assert [(r["point_id"], r["copies"]) for r in joins.duplicate_keys(df).collect()] == [(1, 2)]


def test_scratch_is_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_tables_are_emptied_at_the_end_of_a_block(spark):
    df = spark.range(1000).withColumn("time", F.lit(datetime(1980, 1, 1)).cast("timestamp_ntz"))
    with scratch(spark) as paths:
        assert joins.sync_times(df, df).count() == 1000
        with scratch(spark) as inner:
            assert ordering.number_rows(df, [F.col("id")]).count() == 1000
        kept = materialise(df, "kept")
        written = list(paths)
        paths.pop()
    assert len(written) == 2 and len(inner) == 1 and not set(written) & set(inner)
    left = [spark.read.schema("id long").parquet(p).count() for p in (*paths, *inner)]
    assert left == [0, 0] and kept.count() == 1000


def test_clean_missing_leaves_other_types(spark):
    df = spark.createDataFrame([(1, "a", NAN, [1, 2])], "i int, s string, x double, a array<int>")
    assert tuple(clean_missing(df).first()) == (1, "a", None, [1, 2])


def rows_scanned(df) -> int:
    """Rows that left the Parquet readers, after row groups and pages were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_interleaved_bits():
    """Each number's bits, the highest first, in turn."""
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(0b101, 0b11), (0b010, 0b00), (0b111, 0b01)], "a long, b long")
    got = df.select(clustering.interleaved([(F.col("a"), 3), (F.col("b"), 2)]).alias("z")).collect()
    assert [r["z"] for r in got] == [0b1_01_11, 0b0_10_00, 0b1_10_11]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """The same rows in both orders, in small row groups and pages."""
    pick = lambda k, n: F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(n))
    df = spark.range(100_000, numPartitions=1).select(
        F.lit("Alpes").alias("geo"), F.lit("1979_1980").alias("season"), F.lit(8).alias("month"), pick(5, 50_000).alias("point_id"),
        pick(1, 30).cast("int").alias("massif_number"), (pick(2, 13) * 300).cast("double").alias("zs"),
        (pick(3, 8) * 45).cast("double").alias("aspect"), (pick(4, 3) * 20).cast("double").alias("slope"), F.rand(1).alias("albedo"),
    )
    small = {"parquet.block.size": "524288", "parquet.page.row.count.limit": "1000"}
    hadoop, roots = spark.sparkContext._jsc.hadoopConfiguration(), {}
    try:
        for key, value in small.items():
            hadoop.set(key, value)
        for order in ("site", "interleaved"):
            roots[order] = str(tmp_path_factory.mktemp(order) / "samples")
            samples.write_samples(df, roots[order], order)
    finally:
        for key in small:
            hadoop.unset(key)
    return {k: samples.read_samples(spark, root, df.schema) for k, root in roots.items()}


@pytest.mark.parametrize("lookup,share", [("zs = 2100", 0.6), ("aspect = 90", 0.8)])
def test_interleaved_rows_are_skipped_by_altitude_and_aspect(clustered, lookup, share):
    site, bits = (clustered[k].where(lookup).select("albedo", "zs", "aspect") for k in ("site", "interleaved"))
    assert site.count() == bits.count() > 0
    assert rows_scanned(bits) < share * rows_scanned(site)


@pytest.mark.parametrize("lookup", ["massif_number = 7", "massif_number = 7 and zs = 2100", "point_id = -5"])
def test_lookups_by_massif_and_point_skip_in_both_orders(clustered, lookup):
    for df in clustered.values():
        assert rows_scanned(df.where(lookup).select("albedo", "massif_number", "zs", "point_id")) < 50_000
