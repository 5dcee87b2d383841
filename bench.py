"""Time the headline queries and print one JSON line.

Each query is built and run into a sink that discards rows; the better of two
runs counts.  ``ingest`` joins, filters and writes every monthly unit.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from checks import catalogue, stored, views
from layerframe.plans.ingest import STORED_KEY, build_samples
from layerframe.session import SETTINGS, scratch_path
from layerframe.sources.samples import read_samples, scan_units, write_samples

HEADLINE = [
    "c2_build_samples",
    "a5_pushed_predicates",
    "a6_scan_units",
    "b7_find_profiles",
    "d1_partial_stats",
    "d3_fit_stats",
    "d5_resample_points",
    "d6_histogram",
    "e1_fill_hours",
    "e3_layer_boundaries",
    "e5_assign_batches",
    "h5_refresh_stats",
    "i17_build_features",
    "j4_cos_sza",
    "k1_score_dense",
    "k1_score_conv_net",
    "k2_evaluate",
    "k3_linear_fit",
]


def session(cpus: int) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("layerframe-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "5g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    best = float("inf")
    for _ in range(2):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    wanted = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    seconds: dict[str, float] = {}
    root = scratch_path(spark, "ingested")

    def ingest() -> None:
        built = build_samples(
            stored.raw_forcing(spark, sf),
            stored.raw_profile(spark, sf),
            views.points(spark, sf),
            ("sample_id", *STORED_KEY),
        )
        write_samples(stored.to_sample_table(built), root)

    if not sys.argv[1:]:
        seconds["ingest"] = timed(ingest)
    for name in wanted:
        query = catalogue.QUERIES[name]
        seconds[name] = timed(
            lambda: query(spark, sf).write.format("noop").mode("overwrite").save()
        )
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")),
        "cpus": cpus,
    }
    if "ingest" in seconds:
        units = scan_units(read_samples(spark, root)).count()
        result["ingest_units"] = units
        result["ingest_sec_per_unit"] = round(seconds["ingest"] / units, 4)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
