"""Split, sample and weights."""
import math

from riskspark.operators import sampling as B
from riskspark.sources.tables import applications
from conftest import SF_SMALL


def test_stratified_split_exact_sizes(spark):
    a = applications(spark, SF_SMALL)
    m = B.SplitModel.fit(a)
    out = m.transform(a)
    counts = {(r["split"], r["TARGET"]): r["n"] for r in B.split_summary(out).collect()}
    n = a.count()
    n_test = sum(v for (s, _), v in counts.items() if s == "test")
    assert n_test == math.ceil(0.2 * n)
    for y in (0, 1):
        ny = counts.get(("test", y), 0) + counts.get(("train", y), 0)
        assert abs(counts.get(("test", y), 0) - 0.2 * ny) <= 1
    # deterministic and a projection: same assignment on a rerun
    m2 = B.SplitModel.fit(a)
    assert m.cut == m2.cut


def test_sample_rows_exact_and_seeded(spark):
    a = applications(spark, SF_SMALL)
    s1 = [r["SK_ID_CURR"] for r in B.sample_rows(a, 100).collect()]
    s2 = [r["SK_ID_CURR"] for r in B.sample_rows(a, 100).collect()]
    assert len(s1) == 100 and s1 == s2
    assert set(s1) != {r["SK_ID_CURR"] for r in B.sample_rows(a, 100, seed=7).collect()}


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(100)], "SK_ID_CURR long, TARGET int")
    w = {r["TARGET"]: r["weight"] for r in B.class_weights(df).collect()}
    assert abs(w[1] - 100 / (2 * 10)) < 1e-12 and abs(w[0] - 100 / (2 * 90)) < 1e-12
    assert B.positive_weight(df).first()["scale_pos_weight"] == 9.0


def test_split_is_exact_for_keys_that_share_their_low_bits(spark):
    """Seven keys per low 32 bits: the hash alone ties, the key decides."""
    rows = [((j << 32) + i, int(i % 4 == 0)) for i in range(300) for j in range(7)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int").repartition(5)
    m = B.SplitModel.fit(df)
    n = {r["TARGET"]: r["n"] for r in m.test(df).groupBy("TARGET").count().withColumnRenamed("count", "n").collect()}
    assert sum(n.values()) == math.ceil(0.2 * len(rows)) and n[1] == 0.2 * 525
    assert m.train(df).count() + m.test(df).count() == len(rows)
    assert B.SplitModel.fit(df.repartition(2)).cut == m.cut


def test_rank_cuts_take_exactly_the_first_rows(spark):
    rows = [(y, i % 3, (i % 3) + (i << 32)) for y in (0, 1, None) for i in range(50)]
    d = spark.createDataFrame(rows, "_y int, _h long, _k long")
    cuts = B.rank_cuts(d, {0: 20, 1: 0, None: 50})
    assert cuts[1] is None and cuts[None] == max((h, k) for y, h, k in rows if y is None)
    assert sorted((h, k) for y, h, k in rows if y == 0)[19] == cuts[0]
