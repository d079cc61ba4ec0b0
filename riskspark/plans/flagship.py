"""Flagship: train the logistic model and the decision tree on the split,
score the test part and report, per model, the metrics (E6) with the
best-profit threshold (E10/E11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.plans.training import compare, train_models, workbench


def flagship(spark: SparkSession, sf_dir: str, presets=("logistic", "tree")) -> DataFrame:
    wb = workbench(spark, sf_dir)
    return compare(train_models(wb, presets), wb.test)
