"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks import catalogue
from checks.compare import compare, connect

NAMES = sorted(catalogue.ORACLES)
#: The networks of published size, which SQL cannot follow: a plain loop does, in test_scoring.
ROWS_ONLY = {
    "k1_score_conv_net", "k1_score_conv_net_linear", "k1_score_max_pool_net", "k1_score_initial_net", "k1_score_flat_net",
}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    good, note = compare(
        spark, sf, name, contract.queries()[name], contract.oracle_sql().get(name), duck
    )
    assert good, note


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_published_sizes_score_every_sample(spark, sf, name):
    scored = catalogue.QUERIES[name](spark, sf)
    assert scored.where("yhat IS NOT NULL").count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == ROWS_ONLY


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_a_stable_schema(spark, sf):
    df = contract.entry(spark)
    assert df.columns == ["split", "n", "mse", "mae", "rmse"]
    assert {r["split"] for r in df.collect()} == {"train", "test", "val"}
