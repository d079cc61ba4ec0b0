"""Model registry and metrics history.

Models are saved with ``PipelineModel.write()`` under the shared folder of
the session (``spark.checkpoint.dir`` / ``registry``), one folder per
version; metadata and metrics are append-only Parquet tables beside them, so
any executor or a later job reads the same registry.
"""

from __future__ import annotations

import json
import os
import time
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.models import TrainedModel
from riskspark.operators.prep import ScalerModel
from riskspark.session import checkpoint_dir

META_SCHEMA = ("version string, name string, model_type string, created timestamp, path string, "
               "features string, scaler string, params string, roc_auc double, accuracy double, "
               "precision double, recall double, f1_score double")
METRICS_SCHEMA = ("ts timestamp, version string, metric string, value double")


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or os.path.join(checkpoint_dir(spark), "registry")
        self.meta_path = os.path.join(self.root, "metadata")
        self.metrics_path = os.path.join(self.root, "metrics")

    # R9
    def save(self, model: TrainedModel, metrics: dict | None = None, name: str | None = None) -> str:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        version = f"{name or model.name}_{now.strftime('%Y%m%d_%H%M%S_%f')}"
        path = os.path.join(self.root, "models", version)
        model.model.write().overwrite().save(path)
        m = metrics or {}
        scaler = json.dumps({"means": model.scaler.means, "stds": model.scaler.stds}) if model.scaler else None
        row = (version, name or model.name, type(model.classifier).__name__, now, path,
               json.dumps(model.features), scaler, json.dumps(model.params, default=str),
               *[float(m[k]) if m.get(k) is not None else None
                 for k in ("roc_auc", "accuracy", "precision", "recall", "f1_score")])
        self.spark.createDataFrame([row], META_SCHEMA).write.mode("append").parquet(self.meta_path)
        if m:
            self.record_metrics(version, m, now)
        return version

    # R10
    def list_models(self) -> DataFrame:
        return (self.spark.read.schema(META_SCHEMA).parquet(self.meta_path)
                .orderBy(F.col("created").desc(), F.col("version").desc()))

    # R11
    def latest_version(self) -> str | None:
        row = self.spark.read.schema(META_SCHEMA).parquet(self.meta_path).agg(
            F.max_by("version", F.struct("created", "version")).alias("v")).first()
        return row["v"] if row else None

    def load(self, version: str | None = None) -> TrainedModel:
        version = version or self.latest_version()
        r = self.info(version).first()
        scaler = None
        if r["scaler"]:
            s = json.loads(r["scaler"])
            scaler = ScalerModel(s["means"], s["stds"])
        return TrainedModel(r["name"], PipelineModel.load(r["path"]), json.loads(r["features"]),
                            scaler, json.loads(r["params"]))

    # R12
    def info(self, version: str) -> DataFrame:
        return self.spark.read.schema(META_SCHEMA).parquet(self.meta_path).where(F.col("version") == version)

    # R13
    def record_metrics(self, version: str, metrics: dict, ts: datetime | None = None) -> None:
        ts = ts or datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [(ts, version, k, float(v)) for k, v in metrics.items()
                if isinstance(v, (int, float)) and v is not None]
        self.spark.createDataFrame(rows, METRICS_SCHEMA).write.mode("append").parquet(self.metrics_path)

    def metrics_history(self) -> DataFrame:
        return self.spark.read.schema(METRICS_SCHEMA).parquet(self.metrics_path)

    def latest_metrics(self) -> DataFrame:
        """Latest value of every metric (``max_by`` over the timestamp)."""
        return self.metrics_history().groupBy("metric").agg(
            F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def average_prediction_time(timings: DataFrame, col: str = "seconds") -> DataFrame:
    """Mean of recorded prediction times (0 when none)."""
    return timings.agg(F.coalesce(F.avg(col), F.lit(0.0)).alias("avg_prediction_seconds"))


class Timer:
    """Records wall time of a block into a list (the prediction-time log)."""
    def __init__(self, sink: list):
        self.sink = sink

    def __enter__(self):
        self.t = time.perf_counter()
        return self

    def __exit__(self, *exc):
        self.sink.append(time.perf_counter() - self.t)
