"""Evaluation operators against brute force on small fixtures with ties."""
import random

import numpy as np

from riskspark.operators import evaluate as E


def _fixture(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rnd.random() < 0.3 else 0
        s = round(min(1.0, max(0.0, rnd.gauss(0.35 + 0.25 * y, 0.2))), 2)   # 2 digits: many ties
        rows.append((i, y, s))
    return rows, spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, score double")


def _auc_brute(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rows, df = _fixture(spark)
    got = E.roc_auc(df, "TARGET", "score").first()["roc_auc"]
    assert abs(got - _auc_brute(rows)) < 1e-12


def test_auc_grouped_and_single_class(spark):
    rows, df = _fixture(spark)
    from pyspark.sql import functions as F
    g = df.withColumn("model", F.when(F.col("SK_ID_CURR") % 2 == 0, "a").otherwise("b"))
    res = {r["model"]: r["roc_auc"] for r in E.roc_auc(g, "TARGET", "score", by=["model"]).collect()}
    assert abs(res["a"] - _auc_brute([r for r in rows if r[0] % 2 == 0])) < 1e-12
    one = df.where("TARGET = 1")
    assert E.roc_auc(one, "TARGET", "score").first()["roc_auc"] is None


def test_threshold_sweep_matches_brute_force(spark):
    rows, df = _fixture(spark)
    got = {r["threshold"]: r for r in E.threshold_metrics(df, "TARGET", "score").collect()}
    assert len(got) == 16
    for t in E.METRIC_THRESHOLDS:
        tp = sum(1 for _, y, s in rows if y == 1 and s >= t)
        fp = sum(1 for _, y, s in rows if y == 0 and s >= t)
        fn = sum(1 for _, y, s in rows if y == 1 and s < t)
        r = got[t]
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        assert abs(r["precision"] - (tp / (tp + fp) if tp + fp else 0.0)) < 1e-15


def test_profit_curve_and_best(spark):
    rows, df = _fixture(spark)
    curve = {r["threshold"]: r for r in E.profit_curve(df, "TARGET", "score").collect()}
    assert len(curve) == 80
    best_t, best_p = None, None
    for t in E.PROFIT_THRESHOLDS:
        tp = sum(1 for _, y, s in rows if y == 1 and s >= t)
        fp = sum(1 for _, y, s in rows if y == 0 and s >= t)
        tn = sum(1 for _, y, s in rows if y == 0 and s < t)
        fn = sum(1 for _, y, s in rows if y == 1 and s < t)
        p = (tp + tn + fp) * 1000.0 - fp * 500.0 - fn * 2000.0
        assert curve[t]["profit"] == p
        if best_p is None or p > best_p:
            best_t, best_p = t, p
    b = E.best_row(E.profit_curve(df, "TARGET", "score"), "profit").first()
    assert (b["threshold"], b["profit"]) == (best_t, best_p)


def test_confusion_matrix_has_full_grid(spark):
    _, df = _fixture(spark)
    cm = E.confusion_matrix(df.where("TARGET = 0"), "TARGET", "score", threshold=2.0).collect()
    assert len(cm) == 4 and sum(r["n"] for r in cm) == df.where("TARGET = 0").count()


def test_roc_curve_monotone_and_complete(spark):
    rows, df = _fixture(spark)
    pts = sorted(E.roc_curve(df, "TARGET", "score").collect(), key=lambda r: -r["threshold"])
    assert len(pts) == len({s for _, _, s in rows})
    assert pts[-1]["fpr"] == 1.0 and pts[-1]["tpr"] == 1.0
    assert all(a["fpr"] <= b["fpr"] and a["tpr"] <= b["tpr"] for a, b in zip(pts, pts[1:]))


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.2)], "SK_ID_CURR long, TARGET int, score double")
    r = E.classification_metrics(df, "TARGET", "score").first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1_score"] == 0.0
    assert r["accuracy"] == 1.0


def test_class_report_support(spark):
    _, df = _fixture(spark)
    rep = {r["class"]: r for r in E.class_report(df, "TARGET", "score").collect()}
    n1 = df.where("TARGET = 1").count()
    assert rep["1"]["support"] == n1 and rep["weighted avg"]["support"] == df.count()
