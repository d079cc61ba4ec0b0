"""Streaming scoring (R8): the request-at-a-time scoring service re-aimed as a
Structured Streaming job.

Arriving request files -> request rules (Q3) -> the eight model inputs (R6)
-> model probability -> API risk band (R3) -> ``foreachBatch`` sink.  The
sink writes each micro-batch to its own ``batch_id=N`` folder with overwrite,
so a batch replayed after a failure (the checkpoint records progress)
replaces its earlier output instead of duplicating it: exactly-once results.
Counts and seconds of every batch are written the same way, under ``_batches``
in the sink, which readers of the sink skip.  The query is stateless, so no watermark is needed.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.scores import band_api, api_feature_vector
from riskspark.operators.models import TrainedModel
from riskspark.operators.quality import check_records

REQUEST_SCHEMA = ("SK_ID_CURR bigint, amt_income_total double, amt_credit double, "
                  "amt_annuity double, cnt_children bigint, ext_source_2 double, "
                  "ext_source_3 double, age double, employ_years double")
LOG_SCHEMA = "batch_id bigint, input_rows bigint, accepted_rows bigint, seconds double"


def scored_requests(requests: DataFrame, model: TrainedModel, threshold: float = 0.5) -> DataFrame:
    """The per-record transformation, usable on a batch or a streaming frame:
    (SK_ID_CURR, accepted, failed_rules, probability, prediction, risk_level);
    rejected records keep null scores (the batch API skips them).  They pass the
    model with inputs of 0, so that the requests are read once."""
    keep = ["accepted", "failed_rules"]
    x = api_feature_vector(check_records(requests), keep=keep)
    accepted = lambda c, other=None: F.when(F.col("accepted"), c).otherwise(F.lit(other))
    x = x.withColumns({c: accepted(F.col(c), 0.0) for c in x.columns if c not in ("SK_ID_CURR", *keep)})
    sc = model.score(x, threshold)
    p = F.col(f"p_{model.name}")
    return sc.select("SK_ID_CURR", *keep, accepted(p).alias("probability"),
                     accepted(F.col(f"pred_{model.name}")).alias("prediction"),
                     accepted(band_api(p)).alias("risk_level"))


def start_scoring_stream(spark: SparkSession, source_dir: str, model: TrainedModel,
                         sink_dir: str, checkpoint: str, max_files_per_trigger: int = 1,
                         available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``."""
    src = (spark.readStream.schema(REQUEST_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    out = scored_requests(src, model)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        path, begin = os.path.join(sink_dir, f"batch_id={batch_id}"), time.perf_counter()
        batch.write.mode("overwrite").parquet(path)
        seconds = time.perf_counter() - begin
        own = batch.sparkSession
        own.read.schema(batch.schema).parquet(path).agg(
            F.lit(batch_id).cast("bigint").alias("batch_id"), F.count("*").alias("input_rows"),
            F.count_if("accepted").alias("accepted_rows"), F.lit(seconds).alias("seconds"),
        ).write.mode("overwrite").parquet(os.path.join(_log_dir(sink_dir), f"batch-{batch_id}"))

    spark.createDataFrame([], LOG_SCHEMA).write.mode("append").parquet(_log_dir(sink_dir))

    w = out.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def _log_dir(sink_dir: str) -> str:
    return os.path.join(sink_dir, "_batches")


def progress_table(spark: SparkSession, sink_dir: str) -> DataFrame:
    """R14 input: one row per micro-batch (batch_id, input_rows, accepted_rows,
    seconds to score and write it), of all batches of the sink."""
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(_log_dir(sink_dir))


def read_sink(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)
