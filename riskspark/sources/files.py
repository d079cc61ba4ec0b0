"""File sources and sinks for applicant tables.

Any path ``spark.read`` understands works (local, HDFS, object stores), so a
remote file is the same call as a local one.  Files are split by Spark, so a
large CSV is read by many tasks (the reference's chunked read, S4, is not
needed).  pandas' NaN-as-missing is kept: ``NaN`` strings and empty fields
become null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators.prep import LABEL


class SourceError(ValueError):
    pass


def looks_like_html(spark: SparkSession, path: str) -> bool:
    """A download that returned a web page instead of the CSV (first
    non-empty line starts with '<')."""
    first = (spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect())
    return bool(first) and first[0]["value"].lstrip().startswith("<")


def read_applicants(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    fmt: str = "csv", require_label: bool = False,
                    check_html: bool = True) -> DataFrame:
    """Applicant rows from CSV (header, typed by ``schema`` or
    inferred) or Parquet.  With ``require_label`` a file without ``TARGET``
    is refused (S8, wrong-file detection)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        if check_html and looks_like_html(spark, path):
            raise SourceError(f"{path} is an HTML page, not a CSV file")
        r = spark.read.option("header", True).option("nanValue", "NaN").option("mode", "PERMISSIVE")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        df = r.csv(path)
    # NaN is an ordinary value in Spark aggregates: make it missing, as pandas does
    df = df.select(*[F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
                     if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                     for f in df.schema.fields])
    if require_label and LABEL not in df.columns:
        raise SourceError(f"{LABEL} column not found: label-dependent work needs the training file")
    return df


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows of an uploaded file."""
    return df.limit(rows)


def write_scored(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Scored batch to CSV (header, no index) or Parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
