"""The end-to-end query: statistics, features, scores, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerframe.operators.nets import CONV_NET, waves
from layerframe.plans.evaluation import report

from . import views
from .registry import tidy


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    weights = waves(CONV_NET, views.LAYERS)
    return tidy(report(
        views.samples(spark, sf), views.plan(spark, sf), weights, CONV_NET, views.LAYERS
    ))
