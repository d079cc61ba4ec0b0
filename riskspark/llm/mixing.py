"""Mixing sources to target weights by temperature (operator 9).

Weights are the sources' token shares to the power ``alpha``, normalised.
``alpha`` = 1 keeps the natural mix and 0 makes all sources equal; between them
both the entropy of the weights and the number of times that the scarcest
source repeats are monotone, so bisection finds the ``alpha`` that meets a
target entropy, or the smallest one that stays within a repetition limit.

The weights are realised as budgeted block permutations: each pass ("epoch")
over a source is a fresh permutation of its documents by a seeded hash, passes
follow each other until the source's token budget is full, and the resulting
stream is cut into ``blocks`` of equal budget, each holding every source in
proportion to its weight.

A source's stream is numbered by token sums over ``BUCKETS`` ranges of the hash
(a bounded table) and by windows inside one range, so no task orders a source.
Only one row per source reaches the driver.

Results for odd input: a null source is a source of its own; documents without
tokens take no budget and stay in each whole pass; repeated rows count each;
an empty table gives an empty result; extra columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.shared import staged, table

BUCKETS = 4096
REPETITION_LIMIT = 1.5
BLOCKS = 8
#: A word of a text, as the other operators take it.
WORD = "[^\\x20\\x09-\\x0D]+"


def weights_at(shares: list[float], alpha: float) -> list[float]:
    top = max(shares)
    powers = [(s / top) ** alpha if s > 0 else 0.0 for s in shares]
    total = math.fsum(powers)
    return [p / total for p in powers]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def repetition(shares: list[float], weights: list[float]) -> float:
    """Passes over the scarcest source while the richest is read once."""
    ratio = [w / s for w, s in zip(weights, shares) if s > 0]
    return max(ratio) / min(ratio)


def solve_alpha(shares: list[float], target_entropy: float | None = None,
                repetition_limit: float | None = None, steps: int = 60) -> float:
    """Bisect the exponent in [0, 1].

    With a target entropy: the exponent that meets it (1 or 0 if the target
    lies outside what the shares can reach).  With a repetition limit: the
    smallest exponent (flattest mix) that keeps it.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give a target entropy or a repetition limit")

    def flat_enough(a: float) -> bool:  # true for small alpha
        w = weights_at(shares, a)
        if target_entropy is not None:
            return entropy(w) >= target_entropy
        return repetition(shares, w) > repetition_limit

    if flat_enough(1.0):
        return 1.0
    if not flat_enough(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if flat_enough(mid) else (low, mid)
    return high if repetition_limit is not None else low


def mixing_plan(tokens: dict, budget: int | None = None, **target) -> list[tuple]:
    """(source, tokens, weight, budget) per source with tokens.

    Without a ``budget`` the total is the smallest that reads every source at
    least once, so nothing is left out.
    """
    names = sorted((s for s in tokens if tokens[s] > 0), key=lambda s: (s is not None, s))
    if not names:
        return []
    total = sum(tokens[s] for s in names)
    shares = [tokens[s] / total for s in names]
    weights = weights_at(shares, solve_alpha(shares, **target))
    if budget is None:
        whole = max(tokens[s] / w for s, w in zip(names, weights))
        return [(s, tokens[s], w, max(tokens[s], math.floor(whole * w))) for s, w in zip(names, weights)]
    return [(s, tokens[s], w, math.floor(budget * w)) for s, w in zip(names, weights)]


def mix(docs: DataFrame, tokens: str, source: str = "source", key: str = "doc_id", seed: int = 17,
        budget: int | None = None, blocks: int = BLOCKS, **target) -> DataFrame:
    """One row per document and pass that fits the budget of its source.

    Adds ``epoch`` (0 for the first pass), ``mix_start`` (tokens of the
    source's stream before the row), ``weight`` and ``block``.  A row belongs
    to the stream if it starts below its source's budget.
    """
    spark = docs.sparkSession
    got = docs.groupBy(source).agg(F.sum(tokens).alias("t"), F.count("*").alias("n")).collect()
    plan = mixing_plan({r[0]: r["t"] or 0 for r in got}, budget, **target)
    planned = {p[0] for p in plan}
    # a source without tokens has no weight; its documents are kept once
    plan += [(r[0], 0, 0.0, 0) for r in got if r[0] not in planned]
    kind = dict(docs.dtypes)[source]
    plan_df = spark.createDataFrame([(s, t, w, b, max(1, -(-b // t) if t else 1)) for s, t, w, b in plan],
                                    f"_source {kind}, _tokens long, weight double, _budget long, _passes long")
    rows = docs.join(F.broadcast(plan_df), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_passes").cast("int") - 1)))
    rows = rows.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"),
                                                      F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    rows = rows.withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    return _numbered(rows, tokens, source, key, blocks)


def _numbered(rows: DataFrame, tokens: str, source: str, key: str, blocks: int) -> DataFrame:
    by = ["_src", "epoch", "_bucket"]
    # the plan's columns travel; a null source must still join its offsets
    rows = rows.withColumn("_src", F.struct(F.col(source)))
    sums = rows.groupBy(*by).agg(F.sum(tokens).alias("_sum"))
    before = Window.partitionBy("_src", "epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    own = (Window.partitionBy(*by).orderBy("_hash", F.col(key), F.col(tokens))
           .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("epoch") * F.col("_tokens") + F.col("_offset") + F.coalesce(F.sum(tokens).over(own), F.lit(0))
    placed = (rows.join(offsets, by).withColumn("mix_start", start.cast("long"))
              .filter((F.col("mix_start") < F.col("_budget")) | (F.col("epoch") == 0) & (F.col("_budget") >= F.col("_tokens"))))
    block = F.when(F.col("_budget") > 0,
                   F.least(F.floor(F.col("mix_start") * blocks / F.col("_budget")), F.lit(blocks - 1))).otherwise(0)
    return placed.withColumn("block", block.cast("int")).drop("_src", "_hash", "_bucket", "_tokens", "_budget", "_passes")


def n_tokens(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed stream of all documents: every document at least once,
    scarce sources up to ``REPETITION_LIMIT`` passes; tokens are words."""
    slim = staged(table(spark, sf_dir, "documents").select("doc_id", "source", n_tokens().alias("n_tokens")), "mix")
    out = mix(slim, "n_tokens", repetition_limit=REPETITION_LIMIT)
    return out.select("doc_id", "source", "epoch", "n_tokens", "mix_start", "block", F.round("weight", 9).alias("weight"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of scarce sources appear once per pass."""
    slim = staged(docs.select("doc_id", "source", n_tokens().alias("n_tokens")), "mix-stage")
    copies = (mix(slim, "n_tokens", repetition_limit=REPETITION_LIMIT)
              .groupBy("doc_id").agg(F.count("*").alias("_rows")))
    given = slim.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_given"))
    # passes of a document: its rows in the stream per row that it had
    times = given.join(copies, given._id.eqNullSafe(copies.doc_id)).select(
        "_id", F.ceil(F.col("_rows") / F.col("_given")).cast("int").alias("_times"))
    out = docs.join(times, docs.doc_id.eqNullSafe(times._id))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(docs.columns)
