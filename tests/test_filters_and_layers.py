from __future__ import annotations

import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from layerframe.functions import layers, names, times
from layerframe.functions.sun import cos_sza
from layerframe.operators import features, filters, joins, profiles
from layerframe.operators.stats import Norm
from layerframe.schema import LAYER_VARS, STAT_VARS, wide_columns

NAN = float("nan")
SAMPLE = (
    "sample_id long, time timestamp_ntz, point_id long, zs double, aspect double, slope double, "
    "massif_number int, dz array<double>, ssa array<double>, density array<double>, "
    "conc_soot array<double>, conc_dust array<double>, direct_sw double, diffuse_sw double, "
    "cos_sza double, albedo double"
)


def sample(i, dz, ssa=None, direct=1.0, diffuse=1.0, albedo=0.5, at=datetime(1980, 2, 1, 12)):
    ssa = ssa if ssa is not None else [10.0 * (k + 1) for k in range(len(dz))]
    same = [0.1 * (k + 1) for k in range(len(dz))]
    return (i, at, i, 2700.0, -1.0, 0.0, 3, dz, ssa, same, same, same, direct, diffuse, 0.4, albedo)


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(
        [sample(1, [0.2, 0.3, None]), sample(2, [None, None, None]), sample(3, [0.6, 0.7, 0.8])],
        SAMPLE,
    )


def unit_norm(**std):
    return Norm({v: 0.5 for v in STAT_VARS}, {**{v: 2.0 for v in STAT_VARS}, **std})


def test_nan_is_not_positive_after_cleaning(spark):
    df = spark.createDataFrame([(1, NAN), (2, None), (3, 0.0), (4, 1.0)], "id int, swe double")
    assert df.where("swe > 0").count() == 2, "Spark itself orders NaN above all numbers"
    kept = filters.has_snow(filters.clean_missing(df)).collect()
    assert [r["id"] for r in kept] == [4]


def test_daytime_is_an_or_and_missing_is_night(spark):
    rows = [(1, 0.0, 0.0), (2, 5.0, None), (3, NAN, 2.0), (4, None, None), (5, NAN, 0.0)]
    df = spark.createDataFrame(rows, "id int, direct_sw double, diffuse_sw double")
    kept = filters.is_daytime(filters.clean_missing(df)).collect()
    assert sorted(r["id"] for r in kept) == [2, 3]


def test_cleaning_reaches_into_arrays(spark):
    df = spark.createDataFrame([([1.0, NAN, None],)], "dz array<double>")
    assert filters.clean_missing(df).first()["dz"] == [1.0, None, None]


def test_thickness_caps_skips_and_defaults(table):
    got = {r["sample_id"]: r["t"] for r in table.select("sample_id", layers.thickness("dz").alias("t")).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 1.0}


def test_padding_fills_and_never_cuts(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0, None],), (None,)], "a array<double>")
    got = [r["p"] for r in df.select(layers.pad_layers("a", 2).alias("p")).collect()]
    assert got == [[1.0, None], [1.0, 2.0], [None, None]]
    deeper = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    with pytest.raises(Exception, match="beyond depth 2"):
        deeper.select(layers.pad_layers("a", 2).alias("p")).collect()


def test_profiles_are_stored_as_deep_as_they_are(spark):
    df = spark.createDataFrame([sample(1, [0.05] * 60), sample(2, [0.05, None, 0.1, None, None]), sample(3, [])], SAMPLE)
    got = {r["sample_id"]: r for r in joins.with_surface(df).collect()}
    assert (round(got[1]["thickness"], 6), got[1]["n_layers"], len(got[1]["dz"])) == (1.0, 60, 60)
    assert got[2]["dz"] == [0.05, None, 0.1] and got[3]["dz"] == []
    with pytest.raises(Exception, match="beyond depth 50"):
        features.build_features(df, unit_norm()).collect()
    with pytest.raises(Exception, match="beyond depth 50"):
        features.to_wide(df).collect()
    assert len(features.build_features(df, unit_norm(), (), 60).first()["x_snow"][0]) == 60


def layer_rows(spark, numbers):
    rows = [(1, n, *[float(n)] * 5) for n in numbers]
    return spark.createDataFrame(rows, "sample_id long, layer int, " + ", ".join(f"{v} double" for v in LAYER_VARS))


def test_layers_stand_at_their_number(spark):
    got = features.collect_layers(layer_rows(spark, [3, 1]), "sample_id").first()
    assert got["dz"] == [1.0, None, 3.0]
    whole = features.collect_layers(layer_rows(spark, [2, 1]), "sample_id").first()
    assert whole["ssa"] == [1.0, 2.0]


@pytest.mark.parametrize("numbers", [[0, 1], [1, 1], [1, 1, 3]])
def test_wrong_layer_numbers_are_errors(spark, numbers):
    with pytest.raises(Exception, match="layer numbers must be distinct"):
        features.collect_layers(layer_rows(spark, numbers), "sample_id").collect()


def test_long_names_keep_their_tail(spark):
    df = spark.createDataFrame([("FORCING_" + "x" * 1500,)], "name string")
    assert df.select(names.profile_name("name").alias("p")).first()["p"] == "PRO_" + "x" * 1500


def test_wide_round_trip(table):
    wide = features.to_wide(table, 3)
    assert wide.columns == wide_columns(3)
    assert len(wide_columns(50)) == 309
    back = features.from_wide(wide, 3)
    columns = ["time", "zs", *LAYER_VARS, "direct_sw", "albedo"]
    assert sorted(map(str, back.select(*columns).collect())) == sorted(
        map(str, table.select(*columns).collect())
    )


def test_wide_time_text(table):
    assert features.to_wide(table, 3).first()["time"] == "1980-02-01T12:00:00.000000000"


def test_absent_layers_become_zero_after_scaling(table):
    scaled = features.normalize_layers(table, unit_norm(), 3).where("sample_id = 1").first()
    assert scaled["dz"] == [(0.2 - 0.5) / 2, (0.3 - 0.5) / 2, 0.0]
    assert scaled["snow_layer"] == [1.0, 1.0, 0.0]


def test_zero_deviation_gives_null_not_an_error(table):
    norm = unit_norm(dz=0.0, direct_sw=0.0)
    assert features.normalize_layers(table, norm, 3).first()["dz"] == [None, None, None]
    assert features.normalize_sun(table, norm).first()["direct_sw"] is None


def test_sun_angle_is_scaled_only_for_the_flat_network(table):
    norm = unit_norm()
    conv = features.build_features(table, norm, ("sample_id",), 3).where("sample_id = 1").first()
    flat = features.build_flat_features(table, norm, ("sample_id",), 3).where("sample_id = 1").first()
    assert conv["x_sun"][2] == pytest.approx(0.4)
    assert flat["x"][-1] == pytest.approx((0.4 - 0.5) / 2)
    assert len(flat["x"]) == 6 * 3 + 3
    assert [len(row) for row in conv["x_snow"]] == [3] * 6


def test_thickness_is_taken_before_scaling(table):
    built = features.build_features(table, unit_norm(), ("sample_id",), 3)
    assert {r["sample_id"]: round(r["x_sun"][3], 6) for r in built.collect()} == {1: 0.5, 2: 0.0, 3: 1.0}


def test_features_do_not_depend_on_padding(table):
    norm = unit_norm()
    want = features.build_features(table, norm, ("sample_id",), 4).collect()
    for shape in (layers.ragged, lambda v: layers.pad_layers(v, 4)):
        other = table.withColumns({v: shape(v) for v in LAYER_VARS})
        got = features.build_features(other, norm, ("sample_id",), 4).collect()
        assert {r["sample_id"]: r["x_snow"] for r in got} == {r["sample_id"]: r["x_snow"] for r in want}
    with pytest.raises(Exception, match="beyond depth 2"):
        features.build_features(table, norm, (), 2).collect()


def test_features_stay_within_generated_code(table):
    """The projection compiles: no stage falls back because its code is too long."""
    built = features.build_features(table, unit_norm(), ("sample_id",))
    mode = table.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = built._jdf.queryExecution().explainString(mode)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and 0 < max(sizes) < 64 * 1024


def test_target_scaling_round_trip(table):
    norm = unit_norm()
    back = features.denormalize_target(features.normalize_target(table, norm), norm)
    assert back.first()["albedo"] == pytest.approx(0.5)


def test_profile_boxes_start_at_the_ground(table):
    boxes = profiles.layer_boundaries(table.where("sample_id = 1"), "ssa").orderBy("level").collect()
    assert [(round(b["z_bottom"], 6), round(b["z_top"], 6), b["value"]) for b in boxes] == [
        (0.0, 0.3, 20.0), (0.3, 0.5, 10.0),
    ]
    assert [b["shade"] for b in boxes] == [1.0, 0.0]
    assert profiles.layer_boundaries(table.where("sample_id = 2"), "ssa").count() == 0


def test_shared_mask_for_other_variables(spark):
    df = spark.createDataFrame([sample(1, [0.1, None, 0.3], [5.0, 6.0, None])], SAMPLE)
    got = df.select(layers.ground_first("ssa", "dz").alias("x")).first()["x"]
    assert got == [None, 5.0], "the value of an absent layer goes, the gap of a present one stays"


def test_constant_profile_scales_to_zero(spark):
    df = spark.createDataFrame([([4.0, 4.0],)], "a array<double>")
    assert df.select(layers.unit_scale("a").alias("x")).first()["x"] == [0.0, 0.0]


def test_time_of_day_and_ranges(spark):
    rows = [(1, datetime(1980, 2, 1, 12)), (2, datetime(1980, 2, 8)), (3, datetime(1980, 2, 1))]
    df = spark.createDataFrame(rows, "id int, time timestamp_ntz")
    assert [r["id"] for r in filters.at_time_of_day(df, "12:00:00").collect()] == [1]
    inside = filters.between_times(df, "1980-02-01", "1980-02-08").collect()
    assert sorted(r["id"] for r in inside) == [1, 3]
    with pytest.raises(ValueError):
        filters.slice_times(df, "1980-02-01", "1980-02-07")
    assert filters.slice_times(df, "1980-02-01 06:00:00", "1980-02-07").count() == 1


def test_month_and_columns_are_checked(table):
    with pytest.raises(ValueError):
        filters.by_month(table, 13)
    with pytest.raises(ValueError):
        filters.prune(table, ["nothing"])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 on 10 March 2024 does not exist in New York.
        df = spark.createDataFrame([("2024-03-10 02:30:15.5",)], "t string").select(
            F.col("t").cast("timestamp_ntz").alias("t")
        )
        row = df.select(
            times.micros("t").alias("us"),
            times.hour_start("t").cast("string").alias("hour"),
            times.month_start("t").cast("string").alias("month"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row["us"] == 1710037815500000
    assert (row["hour"], row["month"]) == ("2024-03-10 02:00:00", "2024-03-01 00:00:00")


def test_season_order_runs_from_august(spark):
    months = spark.range(1, 13).orderBy(times.season_order("id")).collect()
    assert [r["id"] for r in months] == [8, 9, 10, 11, 12, 1, 2, 3, 4, 5, 6, 7]


def test_sun_stands_overhead_at_the_equator(spark):
    rows = [(datetime(2023, 3, 21, 12, 7), 0.0, 0.0, 0.0, -1.0), (datetime(2023, 6, 21, 0, 0), 45.0, 0.0, 30.0, 90.0)]
    df = spark.createDataFrame(
        rows, "time timestamp_ntz, lat double, lon double, slope double, aspect double"
    ).select(
        cos_sza("time", "lat", "lon").alias("flat"),
        cos_sza("time", "lat", "lon", "0D", "aspect").alias("level"),
        cos_sza("time", "lat", "lon", "slope", "aspect").alias("tilted"),
    ).collect()
    assert df[0]["flat"] == pytest.approx(1.0, abs=1e-3)
    assert df[1]["flat"] < 0
    for row in df:
        assert row["level"] == pytest.approx(row["flat"], abs=1e-12)
        assert -1 <= row["tilted"] <= 1 and not math.isnan(row["tilted"])
