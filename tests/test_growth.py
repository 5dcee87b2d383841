"""What keeps the queries in proportion to their tables: keys of any size, no sort that grows, files that fit their rows."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from checks import catalogue, views
from checks.section_ab import weighted_sum
from layerframe.functions import layers as L
from layerframe.operators import features
from layerframe.schema import LAYER_VARS, SAMPLE_SCHEMA, STAT_VARS
from layerframe.session import PIECES, dealt
from layerframe.sources import samples, stores
from tests.conftest import plan_of

DAY = datetime.datetime(1997, 3, 4)


@pytest.fixture
def wide_keys(spark, tmp_path):
    """Tables of four orders: numbers beyond a day count of the year 9999, and a negative one."""
    keys = [5, 9_000_000, 3_000_000_000_000_000_000, -7]

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    put("nation", [(0, 0)], "n_nationkey int, n_regionkey int")
    put("customer", [(1, 0)], "c_custkey long, c_nationkey int")
    put("orders", [(k, 1, "F", 100.0, DAY, "1-URGENT") for k in keys],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    put("lineitem", [(k, 1, 1, i, 10.0 * i, 5.0, 0.0, 0.0, DAY) for k in keys for i in (2, 1)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_shipdate timestamp_ntz")
    return str(tmp_path), keys


def test_f2_the_wide_layout_takes_keys_of_any_size(spark, wide_keys):
    sf, keys = wide_keys
    rows = catalogue.QUERIES["i1_to_wide"](spark, sf).select("sample_id", "dz1", "dz2", "dz3").collect()
    assert sorted(map(tuple, rows)) == sorted((k, 0.1, 0.2, None) for k in keys)


def test_f3_layers_are_gathered_without_further_sorts(spark, wide_keys):
    plan = plan_of(views.profiles(spark, wide_keys[0]))
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_f3_partitions_follow_the_scan(spark, tmp_path):
    spark.range(4000).repartition(4).write.parquet(f"{tmp_path}/t")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        table = spark.read.parquet(f"{tmp_path}/t")
        scanned = table.rdd.getNumPartitions()
        assert dealt(table, "id").rdd.getNumPartitions() == PIECES * scanned > 2
        assert sorted(r["id"] for r in dealt(table, "id").collect()) == list(range(4000))
        spark.conf.set("spark.sql.shuffle.partitions", str(PIECES * scanned))
        assert dealt(table, "id") is table
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sample_rows(spark, n):
    given = {"time": F.lit(DAY).cast("timestamp_ntz"), "point_id": F.col("id"), "geo": F.lit("ASIA"),
             "season": F.lit("1996_1997"), "month": F.lit(3), "albedo": F.col("id") / n,
             **{v: F.array(F.col("id") * 0.5, F.lit(2.0)) for v in LAYER_VARS}}
    return spark.range(n).select(*[given.get(f.name, F.lit(1)).cast(f.dataType).alias(f.name) for f in SAMPLE_SCHEMA])


def test_f3_a_small_unit_has_a_small_file(spark, tmp_path):
    """Its Bloom filter used to take a megabyte whatever the unit holds."""
    samples.write_samples(sample_rows(spark, 50), f"{tmp_path}/s")
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/s/data") for f in names if f.endswith(".parquet")]
    assert files and sum(map(os.path.getsize, files)) < 200_000
    assert samples.read_samples(spark, f"{tmp_path}/s").where("point_id = 7").count() == 1


def test_f7_features_are_written_as_their_samples_are_read(spark, tmp_path, monkeypatch):
    root, path = f"{tmp_path}/s", f"{tmp_path}/f"
    samples.write_samples(sample_rows(spark, 50), root)
    norm = stores.Norm({v: 0.0 for v in STAT_VARS}, {v: 1.0 for v in STAT_VARS})
    taken = []
    monkeypatch.setattr(stores, "build_features", lambda df, *a: taken.append(df) or features.build_features(df, *a))
    assert stores.refresh_features(spark, root, path, norm) == 1
    # sorted by unit before the vectors are made, so the writer sorts no padded rows
    assert "Sort [geo" in plan_of(taken[0]) and "Exchange" not in plan_of(taken[0])
    assert stores.read_features(spark, path, stores.feature_schema(("time", "point_id"))).count() == 50


def test_f16_weighted_sum_stays_out_of_lambdas(spark):
    rows = [(1, [1.5, 2.0, 3.0]), (2, []), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [4.0])]
    df = spark.createDataFrame(rows, "i int, x array<double>").coalesce(1)
    got = df.select("i", weighted_sum("x").alias("s")).orderBy("i")
    assert "lambda" not in plan_of(got)
    found = [r["s"] for r in got.collect()]
    assert found[:4] == [14.5, 0.0, None, None] and found[4] != found[4] and found[5] == 4.0
    cut = df.select("i", weighted_sum(F.slice(L.to_float32("x"), 2, 2)).alias("s")).orderBy("i")
    assert [r["s"] for r in cut.collect()] == [8.0, 0.0, None, None, 1.0, 0.0]
