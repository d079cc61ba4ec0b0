"""Data-quality predicates and validation (Q1-Q10).

Every column statistic is computed in one aggregate over all columns (never a
job per column); per-column results are unpivoted into long tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.scores import record_rules
from riskspark.operators.prep import LABEL, NULL_LIMIT

# The reference's summary sizes.
NULL_TOP = 20
MAX_BATCH = 10_000


class ValidationError(ValueError):
    pass


def frame_checks(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Q1: one row per required column: (column, present, n_rows, n_values,
    usable).  A column is usable if the frame has it and it holds a value;
    one aggregate for all columns."""
    have = set(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(c in have).alias("present"),
        (F.count(F.col(c)) if c in have else F.lit(0)).cast("bigint").alias("n_values")) for c in required]).alias("checks"))
    return row.select("n_rows", F.inline("checks")).select("column", "present", "n_rows", "n_values", (F.col("n_values") > 0).alias("usable"))


#: Sizes of one request batch.
BATCH_SIZES = (1, 10_000)


def batch_size(df: DataFrame, least: int = BATCH_SIZES[0], most: int = BATCH_SIZES[1]) -> DataFrame:
    """Q5: (n_records, least, most, within) of one batch."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_records"), F.lit(least).cast("bigint").alias("least"), F.lit(most).cast("bigint").alias("most"),
                  n.between(least, most).alias("within"))


def require_label(df: DataFrame, label: str = LABEL) -> None:
    """Label work needs the label column (wrong-file detection)."""
    if label not in df.columns:
        raise ValidationError(f"{label} column not found; label-dependent work is unavailable")


def range_checks(df: DataFrame, rules: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Q2: (column, min_allowed, max_allowed, n_below, n_above, valid) for all
    rules in one aggregate; missing values pass."""
    aggs = []
    for c, (lo, hi) in rules.items():
        below = (F.col(c) < lo) if lo is not None else F.lit(False)
        above = (F.col(c) > hi) if hi is not None else F.lit(False)
        aggs += [F.sum(F.when(below, 1).otherwise(0)).cast("bigint").alias(f"{c}__below"),
                 F.sum(F.when(above, 1).otherwise(0)).cast("bigint").alias(f"{c}__above")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"),
                      F.lit(lo).cast("double").alias("min_allowed"),
                      F.lit(hi).cast("double").alias("max_allowed"),
                      F.col(f"{c}__below").alias("n_below"),
                      F.col(f"{c}__above").alias("n_above"))
             for c, (lo, hi) in rules.items()]
    return (row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
            .withColumn("valid", (F.col("n_below") == 0) & (F.col("n_above") == 0)))


def check_records(req: DataFrame) -> DataFrame:
    """Q3: each request row with ``accepted`` and the comma-joined names of
    the failed rules (empty when accepted)."""
    rules = record_rules()
    failed = F.concat_ws(",", *[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))
                                for name, cond in rules])
    return req.withColumn("failed_rules", failed).withColumn(
        "accepted", F.col("failed_rules") == "")


def batch_summary(checked: DataFrame, max_batch: int | None = None) -> DataFrame:
    """Q4/Q5: (n_records, n_accepted, n_rejected).  With ``max_batch`` the
    batch size rule 1..max_batch is enforced as an assertion."""
    out = checked.agg(F.count(F.lit(1)).alias("n_records"),
                      F.sum(F.when(F.col("accepted"), 1).otherwise(0)).cast("bigint").alias("n_accepted"))
    out = out.withColumn("n_rejected", F.col("n_records") - F.col("n_accepted"))
    if max_batch is not None:
        n = out.first()["n_records"]
        if not 1 <= n <= max_batch:
            raise ValidationError(f"batch size {n} outside 1..{max_batch}")
    return out


def null_summary(df: DataFrame) -> DataFrame:
    """Null count and rate of every column, one aggregate: (column, position,
    null_count, null_rate)."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("__n"), *[F.sum(F.col(c).isNull().cast("int")).cast("bigint").alias(c)
                                   for c in df.columns])
    parts = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                      F.col(c).alias("null_count")) for i, c in enumerate(df.columns)]
    return (row.select("__n", F.explode(F.array(*parts)).alias("r"))
            .select("r.*", F.try_divide(F.col("r.null_count").cast("double"), F.col("__n"))
                    .alias("null_rate")))


def top_null_columns(df: DataFrame, top: int = NULL_TOP) -> DataFrame:
    """Q6: columns with nulls, most nulls first (ties by name), top 20."""
    return (null_summary(df).where("null_count > 0")
            .orderBy(F.col("null_count").desc(), F.col("column")).limit(top)
            .select("column", "null_count", "null_rate"))


def kept_columns(df: DataFrame, limit: float = NULL_LIMIT) -> DataFrame:
    """Q9: (column, null_rate, kept) with kept = null_rate <= limit."""
    return null_summary(df).select("column", "null_rate",
                                   (F.col("null_rate") <= limit).alias("kept"))


def total_nulls(df: DataFrame) -> DataFrame:
    """Q10: total remaining nulls over all cells."""
    return df.agg(sum((F.sum(F.col(c).isNull().cast("int")).cast("bigint") for c in df.columns),
                      F.lit(0).cast("bigint")).alias("total_nulls"))


def null_rate_by_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Q7: null rate by label of every column that has nulls.  Which columns
    have nulls is a fit statistic."""
    nulls = null_summary(df).where("null_count > 0").orderBy("position")
    cols = [r["column"] for r in nulls.collect()]
    if not cols:
        return df.sparkSession.createDataFrame([], f"column string, {label} int, null_rate double")
    g = df.groupBy(label).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return g.unpivot([label], cols, "column", "null_rate").select("column", label, "null_rate")


def missing_pattern(df: DataFrame) -> DataFrame:
    """Q8: the distinct combinations of null flags over the columns with nulls,
    with their row counts (the heat-map matrix of all rows)."""
    cols = [r["column"] for r in null_summary(df).where("null_count > 0")
            .orderBy("position").collect()]
    flags = df.select(*[F.col(c).isNull().alias(c) for c in cols])
    return flags.groupBy(*cols).agg(F.count("*").alias("n_rows"))
