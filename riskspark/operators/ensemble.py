"""Combining model scores (N1, N2, N5, N6) as column arithmetic.

Scores of several models sit side by side in one scored frame (aligned by
key, never by position), so every combination is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.operators.evaluate import roc_auc

# Per-model voting weights of the reference (logistic, tree,
# forest, xgboost, lightgbm) and the blend weights of the extra models.
VOTING_WEIGHTS = {"logistic": 0.3, "tree": 0.2, "forest": 0.2, "xgboost": 0.2, "lightgbm": 0.1}
BLEND_EXTRA_WEIGHTS = {"forest": 0.2, "xgboost": 0.2, "lightgbm": 0.1}
BLEND_GRID = [float(x) for x in np.arange(0, 1.1, 0.1)]        # 11 weights


def _weighted_sum(cols: Sequence[Column], weights: Sequence[float]) -> Column:
    acc = F.lit(0.0)
    for c, w in zip(cols, weights):
        acc = acc + c * F.lit(float(w))
    return acc


def _normalise(weights: Sequence[float]) -> list[float]:
    tot = sum(weights)
    return [w / tot for w in weights]


def soft_vote(df: DataFrame, score_cols: dict[str, str], use_weights: bool = True,
              threshold: float = 0.5, reference_sum: bool = False) -> DataFrame:
    """Weighted mean of probabilities; weights renormalised over the
    models present.  Without weights every model has weight 1 and the sum is
    divided by the number of models (D7); ``reference_sum`` keeps the plain
    sum instead."""
    names = list(score_cols)
    w = [VOTING_WEIGHTS.get(m, 1.0) if use_weights else 1.0 for m in names]
    if use_weights or not reference_sum:
        w = _normalise(w)
    p = _weighted_sum([F.col(score_cols[m]) for m in names], w)
    return df.withColumn("p_soft", p).withColumn("pred_soft", (p >= threshold).cast("int"))


def hard_vote(df: DataFrame, score_cols: dict[str, str], use_weights: bool = True,
              threshold: float = 0.5) -> DataFrame:
    """Votes of the 0/1 predictions.  Weighted: normalised weights, sum
    >= .5.  Plain: votes >= half the models (a tie counts as 1)."""
    names = list(score_cols)
    preds = [(F.col(score_cols[m]) >= threshold).cast("int") for m in names]
    if use_weights:
        w = _normalise([VOTING_WEIGHTS.get(m, 1.0) for m in names])
        s = _weighted_sum(preds, w)
        pred = (s >= 0.5).cast("int")
    else:
        s = sum(preds, F.lit(0))
        pred = (s >= len(names) / 2).cast("int")
    return df.withColumn("vote", s.cast("double")).withColumn("pred_hard", pred)


def blend(df: DataFrame, score_cols: dict[str, str], weight_logistic: float = 0.5,
          weight_tree: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """logistic/tree weights normalised between themselves, extra models
    at fixed weights, then all renormalised."""
    tot = weight_logistic + weight_tree
    if tot > 0:
        weight_logistic, weight_tree = weight_logistic / tot, weight_tree / tot
    names, w = [], []
    for m in score_cols:
        names.append(m)
        w.append({"logistic": weight_logistic, "tree": weight_tree}.get(m, BLEND_EXTRA_WEIGHTS.get(m, 0.0)))
    w = _normalise(w)
    p = _weighted_sum([F.col(score_cols[m]) for m in names], w)
    return df.withColumn("p_blend", p).withColumn("pred_blend", (p >= threshold).cast("int"))


def blend_weight_auc(df: DataFrame, first: str, second: str, label: str = "TARGET",
                     grid: Sequence[float] = BLEND_GRID) -> DataFrame:
    """ROC-AUC of ``w * first + (1 - w) * second`` for w in 0, .1 ... 1.
    Rows are expanded by the fixed 11-value grid before the map-side
    aggregation, then one grouped exact AUC (by w)."""
    warr = F.array(*[F.lit(float(w)) for w in grid])
    long = df.select(label, F.explode(warr).alias("w"), F.col(first), F.col(second))
    long = long.withColumn("p", F.col("w") * F.col(first) + (1 - F.col("w")) * F.col(second))
    return roc_auc(long, label, "p", by=["w"])
