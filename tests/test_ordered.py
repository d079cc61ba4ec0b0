"""Order statistics against numpy."""
import random

import numpy as np
from pyspark.sql import functions as F

from riskspark.operators import ordered
from riskspark.operators.ordered import _at_ranks, exact_quantiles, quantile_map, running_totals


def test_exact_quantiles_by_group_match_numpy(spark):
    rnd = random.Random(7)
    rows = [(i % 3 if i % 11 else None, float(rnd.choice([1, 2, 2, 3, 5, 8, 13])) if i % 5 else None,
             rnd.uniform(-1e6, 1e6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, by="g")
    for g in (0, 1, 2, None):
        for at, c in ((1, "a"), (2, "b")):
            assert got[g, c] == list(np.quantile([r[at] for r in rows if r[0] == g and r[at] is not None], probs))
    assert exact_quantiles(df, ["b"], [0.3])[None, "b"] == [np.quantile([r[2] for r in rows], 0.3)]


def test_quantile_map_single_value_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    m = quantile_map(df, ["a", "b"], [0.25, 0.5])
    assert m["a"] == [1.0, 1.0] and m["b"] == [None, None]
    assert quantile_map(df.where("false"), ["a"], [0.5]) == {"a": [None]}


def test_quantile_map_of_many_rows_with_a_hot_value(spark):
    """90,000 rows: all distinct values, one value in a third of the rows, few values, nulls."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1e5, 90_000), rng.exponential(3, 90_000)
    b[rng.random(90_000) < 1 / 3] = 2.5
    c = np.where(rng.random(90_000) < 0.2, np.nan, rng.integers(0, 4, 90_000))
    df = spark.createDataFrame([(float(x), float(y), None if np.isnan(z) else int(z)) for x, y, z in zip(a, b, c)],
                               "a double, b double, c int").repartition(7)
    probs = [0.0, 1e-5, 0.1, 0.25, 0.5, 0.500001, 0.75, 0.9, 1.0]
    got = quantile_map(df, ["a", "b", "c"], probs)
    assert got["a"] == list(np.quantile(a, probs)) and got["b"] == list(np.quantile(b, probs))
    assert got["c"] == list(np.quantile(c[~np.isnan(c)], probs))
    near = quantile_map(df, ["a"], [0.5], approx=True)["a"][0]
    assert abs((a <= near).mean() - 0.5) < 2e-4


def test_a_rank_outside_its_bracket_is_found(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)], "a double")
    assert _at_ranks(df, {"a": [(10.0, 20.0)]}, {("a", 15), ("a", 500)}) == {("a", 15): 15.0}


def test_running_totals_match_cumsum(spark):
    rnd = random.Random(1)
    vals = sorted({round(rnd.random(), 4) for _ in range(500)})
    rows = [(v, rnd.randint(0, 5)) for v in vals]
    df = spark.createDataFrame(rows, "s double, c long")
    out = sorted((r["s"], r["cum_c"]) for r in running_totals(df, [], "s", ["c"], buckets=7).collect())
    exp = np.cumsum([c for _, c in rows])
    assert [c for _, c in out] == list(exp)
    desc = sorted(((r["s"], r["cum_c"]) for r in
                   running_totals(df, [], "s", ["c"], buckets=7, descending=True).collect()), reverse=True)
    assert [c for _, c in desc] == list(np.cumsum([c for _, c in reversed(rows)]))


def test_brackets_hold_the_quantiles_of_uneven_parts(spark):
    """Parts of very unlike values and sizes, as files sorted by a column give them."""
    rng = np.random.default_rng(5)
    parts = [rng.normal(m, 1 + m, size) for m, size in zip(range(40), rng.integers(1, 900, 40))]
    rows = [(i, float(v)) for i, p in enumerate(parts) for v in p]
    df = spark.createDataFrame(rows, "i int, a double").repartitionByRange(16, "i").select("a", F.lit(None).cast("double").alias("empty"))
    a = np.sort([r[1] for r in rows])
    probs = [0.25, 0.5, 0.9]
    found = ordered._approximate(df, ["a"], probs)["a"]
    for p, v in zip(probs, found):
        assert abs(np.searchsorted(a, v) / len(a) - p) <= ordered.MARGIN
    assert quantile_map(df, ["a", "empty"], probs) == {"a": list(np.quantile(a, probs)), "empty": [None] * 3}
