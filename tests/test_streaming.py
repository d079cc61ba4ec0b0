"""The scoring stream returns every request and logs every micro-batch."""
import os
import tempfile

from pyspark.sql import functions as F

from riskspark.streaming.scoring import REQUEST_SCHEMA, progress_table, read_sink, scored_requests, start_scoring_stream


class Half:
    """A model that gives every row 0.5 and fails on null inputs."""
    name = "half"

    def score(self, df, threshold=0.5):
        sound = F.when(F.col("AMT_CREDIT").isNull() | F.col("AGE").isNull(), F.raise_error(F.lit("null input")).cast("double"))
        return df.withColumn("p_half", F.coalesce(sound, F.lit(0.5))).withColumn("pred_half", F.lit(1))


def test_rejected_requests_stay_and_every_batch_is_logged(spark):
    good = (50_000.0, 100_000.0, 5_000.0, 1, 0.5, 0.5, 40.0, 5.0)
    rows = [(i, *good) if i % 3 else (i, -1.0, None, *good[2:6], None, 5.0) for i in range(30)]
    run = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, sink = os.path.join(run, "requests"), os.path.join(run, "out")
    requests = spark.createDataFrame(rows, REQUEST_SCHEMA)
    requests.repartition(3).write.parquet(src)
    start_scoring_stream(spark, src, Half(), sink, os.path.join(run, "ckpt")).awaitTermination()
    for got in (scored_requests(requests, Half()), read_sink(spark, sink)):
        got = {r["SK_ID_CURR"]: r for r in got.collect()}
        assert set(got) == set(range(30))
        for i, r in got.items():
            assert r["accepted"] == bool(i % 3) == (r["failed_rules"] == "")
            assert (r["probability"], r["prediction"], r["risk_level"]) == ((0.5, 1, "Medium") if i % 3 else (None, None, None))
    log = progress_table(spark, sink).collect()
    assert sorted(r["batch_id"] for r in log) == list(range(3))
    assert (sum(r["input_rows"] for r in log), sum(r["accepted_rows"] for r in log)) == (30, 20)
    assert all(r["seconds"] > 0 for r in log)
