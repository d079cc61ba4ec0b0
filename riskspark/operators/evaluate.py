"""Evaluation and threshold choice (E1-E13) on scored DataFrames.

Scored rows carry a 0/1 label and a probability.  Several models are
evaluated in one pass by grouping on a ``model`` column (long form).

Scale notes
* Confusion counts are one grouped aggregate (partial aggregation).
* Threshold sweeps never join rows with thresholds: each row is assigned the
  number of thresholds at or below its score (a fixed-size literal array), rows
  are counted per index, and suffix sums run over at most ``len(thresholds)+1``
  rows per model.
* ROC-AUC is exact with ties: rows collapse to distinct scores, then the
  bucketed running totals of ``ordered.running_totals`` give negatives below
  each score; no un-partitioned window over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.keys import count_below
from riskspark.operators.ordered import running_totals

# Threshold grids and business parameters of the reference.
METRIC_THRESHOLDS = [float(x) for x in np.arange(0.1, 0.9, 0.05)]     # 16 values
PROFIT_THRESHOLDS = [float(x) for x in np.arange(0.1, 0.9, 0.01)]     # 80 values
REVENUE_PER_LOAN = 1000.0
COST_FALSE_POSITIVE = 500.0
COST_FALSE_NEGATIVE = 2000.0
DEFAULT_THRESHOLD = 0.5


def _ratio(num: Column, den: Column) -> Column:
    """num / den with a zero denominator giving 0 (``zero_division=0``)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def metric_columns(tp="tp", tn="tn", fp="fp", fn="fn") -> list[Column]:
    tp, tn, fp, fn = (F.col(x) for x in (tp, tn, fp, fn))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return [
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _ratio(tn, tn + fp).alias("specificity"),
    ]


def confusion_counts(df: DataFrame, label: str, score: str | None = None,
                     threshold: float = DEFAULT_THRESHOLD, by: Sequence[str] = (),
                     pred: str | None = None) -> DataFrame:
    """(by..., tp, tn, fp, fn) in one aggregate; prediction = score >= t."""
    y = F.col(label) == 1
    p = (F.col(pred) == 1) if pred else (F.col(score) >= F.lit(threshold))
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return df.groupBy(*by).agg(cnt(y & p).alias("tp"), cnt(~y & ~p).alias("tn"),
                               cnt(~y & p).alias("fp"), cnt(y & ~p).alias("fn"))


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows collapsed to distinct scores: (by..., s, pos, neg)."""
    y = F.col(label) == 1
    return df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(y, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(y, 0).otherwise(1)).cast("bigint").alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC with ties counted half: (by..., roc_auc).

    AUC = sum_s pos(s) * (2*neg_below(s) + neg(s)) / (2 * P * N); the
    numerator is summed as an exact integer (decimal(38,0)).
    """
    sc = score_counts(df, label, score, by)
    cum = running_totals(sc, list(by), "s", ["neg"])
    num = (F.col("pos").cast("decimal(38,0)")
           * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg")).cast("decimal(38,0)"))
    agg = cum.groupBy(*by).agg(F.sum(num).alias("_num"), F.sum("pos").alias("_p"),
                               F.sum("neg").alias("_n"))
    den = F.lit(2.0) * F.col("_p").cast("double") * F.col("_n").cast("double")
    return agg.select(*by, F.when(den > 0, F.col("_num").cast("double") / den).alias("roc_auc"))


def side_by_side(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns of two results per group: a key join with groups; without
    groups both are one-row results, combined by union + aggregate (no join)."""
    if by:
        return a.join(b, list(by))
    ca = [c for c in a.columns]
    cb = [c for c in b.columns if c not in ca]
    ta = {f.name: f.dataType for f in a.schema.fields}
    tb = {f.name: f.dataType for f in b.schema.fields}
    u = (a.select(*ca, *[F.lit(None).cast(tb[c]).alias(c) for c in cb])
         .unionByName(b.select(*[F.lit(None).cast(ta[c]).alias(c) for c in ca], *cb)))
    return u.agg(*[F.max(c).alias(c) for c in ca + cb])


def classification_metrics(df: DataFrame, label: str, score: str,
                           threshold: float = DEFAULT_THRESHOLD,
                           by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, f1, specificity, counts and AUC."""
    cc = confusion_counts(df, label, score, threshold, by)
    out = cc.select(*by, *metric_columns(), "tp", "tn", "fp", "fn")
    auc = roc_auc(df, label, score, by)
    return side_by_side(out, auc, by)


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, highest first: (by..., threshold,
    fpr, tpr).  Intermediate collinear points are kept."""
    sc = score_counts(df, label, score, by)
    cum = running_totals(sc, list(by), "s", ["pos", "neg"], descending=True)
    tot = sc.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if by:
        j = cum.join(tot, list(by))
    else:                       # two fitted totals as literals, no join
        t = tot.first()
        j = cum.withColumns({"_p": F.lit(t["_p"] or 0), "_n": F.lit(t["_n"] or 0)})
    return j.select(*by, F.col("s").alias("threshold"),
                    _ratio(F.col("cum_neg"), F.col("_n")).alias("fpr"),
                    _ratio(F.col("cum_pos"), F.col("_p")).alias("tpr"))


def confusion_matrix(df: DataFrame, label: str, score: str | None = None,
                     threshold: float = DEFAULT_THRESHOLD, by: Sequence[str] = (),
                     pred: str | None = None) -> DataFrame:
    """The full 2x2 grid (by..., actual, predicted, n), zeros included."""
    cc = confusion_counts(df, label, score, threshold, by, pred)
    cell = lambda a, p, c: F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                                    F.col(c).alias("n"))
    return (cc.select(*by, F.explode(F.array(cell(0, 0, "tn"), cell(0, 1, "fp"),
                                             cell(1, 0, "fn"), cell(1, 1, "tp"))).alias("c"))
            .select(*by, "c.actual", "c.predicted", "c.n"))


def class_report(df: DataFrame, label: str, score: str,
                 threshold: float = DEFAULT_THRESHOLD, by: Sequence[str] = ()) -> DataFrame:
    """E5: per-class precision/recall/f1/support plus macro and weighted means."""
    cc = confusion_counts(df, label, score, threshold, by)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    n = s0 + s1
    row = lambda name, p, r, f1, sup: F.struct(
        F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
        f1.alias("f1_score"), sup.cast("double").alias("support"))
    rows = F.array(
        row("0", p0, r0, f(p0, r0), s0),
        row("1", p1, r1, f(p1, r1), s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f(p0, r0) + f(p1, r1)) / 2, n),
        row("weighted avg", (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
            (f(p0, r0) * s0 + f(p1, r1) * s1) / n, n))
    return cc.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def threshold_counts(df: DataFrame, label: str, score: str, thresholds: Sequence[float],
                     by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, tp, tn, fp, fn) for every threshold, one pass.

    Each row gets ``c`` = number of thresholds <= score; ``t_i`` predicts
    positive exactly for rows with ``c > i``.
    """
    ts = [float(t) for t in thresholds]
    arr = F.array(*[F.lit(t) for t in ts])
    y = F.col(label) == 1
    counted = (df.select(*by, y.alias("_y"),
                         count_below(F.col(score), ts, inclusive=True).alias("_c"))
               .groupBy(*by, "_c").agg(F.sum(F.when(F.col("_y"), 1).otherwise(0)).alias("_pos"),
                                        F.sum(F.when(F.col("_y"), 0).otherwise(1)).alias("_neg")))
    # grid of all indices 0..n per group, so empty indices still appear
    groups = counted.select(*by).distinct() if by else None
    idx = F.explode(F.sequence(F.lit(0), F.lit(len(ts)))).alias("_c")
    grid = (groups.select(*by, idx) if by else
            df.sparkSession.range(1).select(idx))
    full = grid.join(counted, [*by, "_c"], "left").fillna(0, ["_pos", "_neg"])
    w = (Window.partitionBy(*by).orderBy(F.col("_c").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    wall = Window.partitionBy(*by)
    full = full.select(*by, "_c",
                       F.sum("_pos").over(w).alias("_sp"), F.sum("_neg").over(w).alias("_sn"),
                       F.sum("_pos").over(wall).alias("_P"), F.sum("_neg").over(wall).alias("_N"))
    # threshold i uses suffix sums from index c = i + 1
    tarr = F.array(*[F.lit(t) for t in ts])
    out = (full.where(F.col("_c") >= 1)
           .select(*by, F.element_at(tarr, F.col("_c").cast("int")).alias("threshold"),
                   F.col("_sp").cast("bigint").alias("tp"), F.col("_sn").cast("bigint").alias("fp"),
                   (F.col("_P") - F.col("_sp")).cast("bigint").alias("fn"),
                   (F.col("_N") - F.col("_sn")).cast("bigint").alias("tn")))
    return out.select(*by, "threshold", "tp", "tn", "fp", "fn")


def threshold_metrics(df: DataFrame, label: str, score: str,
                      thresholds: Sequence[float] = METRIC_THRESHOLDS,
                      by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, accuracy at each threshold."""
    tc = threshold_counts(df, label, score, thresholds, by)
    return tc.select(*by, "threshold", *metric_columns(), "tp", "tn", "fp", "fn")


def best_row(df: DataFrame, metric: str, by: Sequence[str] = (),
             tie: str = "threshold") -> DataFrame:
    """Row of maximal ``metric`` per group, first ``tie`` value on ties
    (E8, E11).  The window holds one sweep (a fixed number of rows) per group."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), F.col(tie).asc())
    if not by:
        return df.orderBy(F.col(metric).desc(), F.col(tie).asc()).limit(1)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def profit_curve(df: DataFrame, label: str, score: str,
                 thresholds: Sequence[float] = PROFIT_THRESHOLDS,
                 revenue: float = REVENUE_PER_LOAN, cost_fp: float = COST_FALSE_POSITIVE,
                 cost_fn: float = COST_FALSE_NEGATIVE, by: Sequence[str] = ()) -> DataFrame:
    """profit = (TP+TN+FP)*revenue - FP*cost_fp - FN*cost_fn, approvals
    = TP+TN+FP (the reference's formula, D11)."""
    tc = threshold_counts(df, label, score, thresholds, by)
    appr = F.col("tp") + F.col("tn") + F.col("fp")
    profit = (appr.cast("double") * revenue - F.col("fp").cast("double") * cost_fp
              - F.col("fn").cast("double") * cost_fn)
    return tc.select(*by, "threshold", profit.alias("profit"),
                     appr.cast("bigint").alias("approvals"), "tp", "tn", "fp", "fn")


def cost_breakdown(best: DataFrame, revenue: float = REVENUE_PER_LOAN,
                   cost_fp: float = COST_FALSE_POSITIVE, cost_fn: float = COST_FALSE_NEGATIVE,
                   by: Sequence[str] = ()) -> DataFrame:
    """Five lines (category, amount) at the chosen threshold row."""
    line = lambda i, name, amt: F.struct(F.lit(i).alias("line"), F.lit(name).alias("category"),
                                         amt.cast("double").alias("amount"))
    rows = F.array(
        line(1, "Revenue (True Positives)", F.col("tp") * revenue),
        line(2, "Revenue (Other Approvals)", (F.col("tn") + F.col("fp")) * revenue),
        line(3, "Cost (False Positives)", -F.col("fp") * cost_fp),
        line(4, "Cost (False Negatives)", -F.col("fn") * cost_fn),
        line(5, "Net Profit", F.col("profit")))
    return best.select(*by, "threshold", F.explode(rows).alias("r")).select(*by, "threshold", "r.*")


def default_vs_best(df: DataFrame, label: str, score: str,
                    thresholds: Sequence[float] = PROFIT_THRESHOLDS,
                    default: float = DEFAULT_THRESHOLD, by: Sequence[str] = (),
                    **costs) -> DataFrame:
    """Threshold, profit, approvals, FP, FN at 0.5 and at the best
    threshold, with the improvement (best - default)."""
    curve = profit_curve(df, label, score, thresholds, by=by, **costs)
    best = best_row(curve, "profit", by)
    dflt = profit_curve(df, label, score, [default], by=by, **costs)
    cols = ["threshold", "profit", "approvals", "fp", "fn"]
    b = best.select(*by, *[F.col(c).cast("double").alias(f"best_{c}") for c in cols])
    d = dflt.select(*by, *[F.col(c).cast("double").alias(f"default_{c}") for c in cols])
    j = side_by_side(b, d, by)
    row = lambda c: F.struct(F.lit(c).alias("metric"), F.col(f"default_{c}").alias("default"),
                             F.col(f"best_{c}").alias("optimal"),
                             (F.col(f"best_{c}") - F.col(f"default_{c}")).alias("improvement"))
    return j.select(*by, F.explode(F.array(*[row(c) for c in cols])).alias("r")).select(*by, "r.*")


def model_comparison(long: DataFrame, label: str = "TARGET", score: str = "score",
                     model: str = "model", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One metrics row per model from a long (model, label, score) frame."""
    return classification_metrics(long, label, score, threshold, by=[model])


def best_per_metric(comparison: DataFrame, model: str = "model",
                    metrics=("accuracy", "precision", "recall", "f1_score", "roc_auc")) -> DataFrame:
    """Best model per metric (ties: first model name)."""
    long = comparison.select(model, *metrics).unpivot([model], list(metrics), "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col(model).asc())
    return (long.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("metric", F.col(model).alias("best_model"), "value"))


def comparison_long(comparison: DataFrame, model: str = "model",
                    metrics=("accuracy", "precision", "recall", "f1_score", "roc_auc")) -> DataFrame:
    """``melt`` of the comparison table to (model, metric, value)."""
    return comparison.select(model, *metrics).unpivot([model], list(metrics), "metric", "value")
