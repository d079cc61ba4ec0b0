"""Density and box summaries against direct computation."""
import math
import random

import numpy as np

from riskspark.operators.profile import box_summary, describe, kernel_density


def test_density_is_that_of_all_rows(spark):
    rnd = random.Random(3)
    rows = [(i % 2, rnd.gauss(0.4 + 0.2 * (i % 2), 0.1) if i % 9 else None) for i in range(4000)]
    rows += [(0, 0.5)] * 1500                      # one value in a third of the rows
    rows += [(2, 7.0)] * 5 + [(None, 1.0), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "y int, v double").repartition(5)
    got = kernel_density(df, "v", by=["y"]).collect()
    assert {r["y"] for r in got} == {0, 1, None}   # a single value has no density
    for y in (0, 1, None):
        v = np.array([x for g, x in rows if g == y and x is not None])
        curve = sorted((r["x"], r["density"]) for r in got if r["y"] == y)
        width = v.std(ddof=1) * len(v) ** -0.2
        x, d = np.array(curve).T
        assert abs(np.trapezoid(d, x) - 1) < 1e-6 and len(x) == 500
        want = np.exp(-((x[:, None] - v) / width) ** 2 / 2).sum(1) / (len(v) * width * math.sqrt(2 * math.pi))
        assert np.abs(d - want).max() < 2e-4 * want.max()


def test_density_of_nothing(spark):
    assert kernel_density(spark.createDataFrame([(1, None)], "y int, v double"), "v", by=["y"]).count() == 0
    assert kernel_density(spark.createDataFrame([(1, 1.0), (1, 3.0)], "y int, v double"), "v").count() == 500


def test_box_summary_and_describe(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0, 1, None]), float(rnd.randint(0, 60) ** 2), None) for _ in range(900)] + [(1, None, None), (0, 1e6, None)]
    df = spark.createDataFrame(rows, "TARGET int, a double, b double")
    got = {(r["TARGET"], r["column"]): r for r in box_summary(df, ["a", "b", "missing"]).collect()}
    assert set(got) == {(0, "a"), (1, "a"), (None, "a")}
    for y in (0, 1, None):
        v, r = np.array([a for t, a, _ in rows if t == y and a is not None]), got[y, "a"]
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (
            q1, q2, q3, inside.min(), inside.max(), len(v) - len(inside))
    r = describe(df, ["b", "a"]).collect()
    assert [x["column"] for x in r] == ["b", "a"] and r[0]["count"] == 0 and r[0]["q50"] is None
    assert r[1]["q50"] == np.quantile([a for _, a, _ in rows if a is not None], 0.5)
