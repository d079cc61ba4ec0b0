"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers
are used by tests, ``bench.py`` and command-line entry points.  On a cluster
the session comes from the platform and only ``checkpoint_dir`` is consulted.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces shuffle
# partitions at runtime, and splits skewed join partitions (a key holding a
# third of the rows is split across tasks instead of landing on one).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "riskspark", cpus: int | str = "*",
                  shuffle_partitions: int = 8, memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and benchmarks."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", memory))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Where it is unset,
    a local session (tests) gets a scratch folder; on a cluster, whose machines
    share no local folder, that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        d = tempfile.mkdtemp(prefix="riskspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later jobs
    and lost executors read it instead of computing it again."""
    path = os.path.join(checkpoint_dir(df.sparkSession), name, uuid.uuid4().hex)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
