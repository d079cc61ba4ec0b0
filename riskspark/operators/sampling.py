"""Sampling, split, balance and weights.

Randomness is a portable hash of the row key, ``(key * 2654435761 + seed)
mod 2^32``, so Spark, DuckDB and a rerun after an executor loss all draw the
same rows (no dependence on partitioning or task order).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.keys import hash_key
from riskspark.operators.prep import KEY, LABEL

# Fixed values of the split: test share and seed of the reference.
TEST_SIZE = 0.2
SEED = 42


def sample_rows(df: DataFrame, n: int, seed: int = SEED, key: str = KEY) -> DataFrame:
    """S3: exactly ``min(n, count)`` rows, seeded.  TakeOrdered keeps at most
    ``n`` rows per partition, so the sample is bounded by ``n``, not the data."""
    return df.orderBy(hash_key(key, seed), F.col(key)).limit(n)


def sample_info(df: DataFrame, n: int, seed: int = SEED, key: str = KEY) -> DataFrame:
    """(total_rows, sample_rows, is_sampled) beside a sample of ``n``."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.least(F.col("total_rows"), F.lit(n)).cast("bigint").alias("sample_rows"),
        (F.col("total_rows") > n).alias("is_sampled"))


def _test_allocation(counts: dict, test_size: float) -> dict:
    """Per-label test counts of a stratified split: total test size
    ``ceil(test_size * n)``; the train size is spread over labels by largest
    remainder (ties: smaller label first); test = count - train."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    cont = {k: c * n_train / n for k, c in counts.items()}
    fl = {k: math.floor(v) for k, v in cont.items()}
    need = n_train - sum(fl.values())
    order = sorted(counts, key=lambda k: (-(cont[k] - fl[k]), k))
    for k in order[:need]:
        fl[k] += 1
    return {k: counts[k] - fl[k] for k in counts}


def rank_cuts(d: DataFrame, ranks: dict) -> dict:
    """``{y: (hash, key)}`` of the row of rank ``ranks[y]`` (from 1; None for 0)
    among the rows of ``y`` by (hash, key).  ``d``: ``_y``, ``_h`` (32 bits), ``_k``.

    A histogram of the hashes' top 16 bits finds the bucket of each rank; a
    window over the few rows of that bucket (about one in 65,536) finds the row."""
    d = d.withColumn("_hb", F.shiftright("_h", 16))
    upto = Window.partitionBy("_y").orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.lit(0)
    for y, k in ranks.items():
        rank = F.when(F.col("_y").eqNullSafe(F.lit(y)), F.lit(k)).otherwise(rank)
    hist = d.groupBy("_y", "_hb").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))   # <= 65,536 rows a label
    buckets = hist.where((F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto"))).select(
        "_y", "_hb", (rank - (F.col("_upto") - F.col("_n"))).alias("_need"))
    rows = d.alias("d").join(F.broadcast(buckets).alias("b"), F.col("d._y").eqNullSafe(F.col("b._y")) & (F.col("d._hb") == F.col("b._hb"))).select(
        "d._y", "_h", "_k", "_need")
    place = F.row_number().over(Window.partitionBy("_y").orderBy("_h", "_k"))
    found = rows.withColumn("_r", place).where(F.col("_r") == F.col("_need")).select("_y", "_h", "_k").collect()   # one row a label
    return dict.fromkeys(ranks) | {r["_y"]: (r["_h"], r["_k"]) for r in found}


def up_to(cut: tuple | None, h: "F.Column", key: "F.Column") -> "F.Column":
    """Rows up to the (hash, key) pair; none for None."""
    if cut is None:
        return F.lit(False)
    return (h < cut[0]) | ((h == cut[0]) & (key <= cut[1]))


@dataclass
class SplitModel:
    """B1 fitted: per label, the last (hash, key) pair that goes to the test
    part.  ``transform`` is a projection (no shuffle).  Keys that share a hash
    (equal in their lowest 32 bits) are told apart by the key, so the counts
    are exact for all keys."""
    cut: dict
    seed: int = SEED
    key: str = KEY
    label: str = LABEL

    @classmethod
    def fit(cls, df: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED,
            key: str = KEY, label: str = LABEL) -> "SplitModel":
        d = df.select(F.col(label).alias("_y"), hash_key(key, seed).alias("_h"), F.col(key).alias("_k"))
        counts = {r["_y"]: r["n"] for r in d.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cls(rank_cuts(d, _test_allocation(counts, test_size)), seed, key, label)

    def is_test(self) -> "F.Column":
        out = F.lit(False)
        for y, cut in self.cut.items():
            out = F.when(F.col(self.label).eqNullSafe(F.lit(y)), up_to(cut, hash_key(self.key, self.seed), F.col(self.key))).otherwise(out)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("split", F.when(self.is_test(), "test").otherwise("train"))

    def train(self, df: DataFrame) -> DataFrame:
        return df.where(~self.is_test())

    def test(self, df: DataFrame) -> DataFrame:
        return df.where(self.is_test())


def split_summary(split_df: DataFrame, label: str = LABEL) -> DataFrame:
    """(split, label, n) counts of a split frame."""
    return split_df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """B2: balanced class weights n / (k * n_c): (label, n, weight)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return g.select(label, "n", (F.sum("n").over(w).cast("double")
                                 / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = LABEL, col: str = "weight") -> DataFrame:
    """Attach B2 weights as a column (the weight table has one row per label
    value, so the join's build side is bounded by the label cardinality)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(col))
    return df.join(F.broadcast(w), label)


def positive_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """n_negative / n_positive."""
    y = F.col(label)
    return df.agg(F.try_divide(F.sum(F.when(y == 0, 1).otherwise(0)).cast("double"),
                               F.sum(F.when(y == 1, 1).otherwise(0)).cast("double"))
                  .alias("scale_pos_weight"))
