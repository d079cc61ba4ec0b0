"""The reference's preprocessing tests, re-expressed on Spark frames."""
import math

from pyspark.sql import functions as F

from riskspark.functions.features import derive_features
from riskspark.operators.prep import FeatureModel, Preparation, PrepModel, clean_and_derive, fit_category_codes

BASIC = ("SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, DAYS_BIRTH long, "
         "DAYS_EMPLOYED long, TARGET int")


def test_age_and_employment_years(spark):
    df = spark.createDataFrame([(1, 100000.0, 200000.0, -10000, -1000, 0),
                                (2, 150000.0, 300000.0, -15000, -2000, 1),
                                (3, 200000.0, 400000.0, -20000, -3000, 0)], BASIC)
    out = clean_and_derive(df).collect()
    assert all(r["AGE"] > 0 and r["EMPLOY_YEARS"] > 0 for r in out)
    assert abs(out[0]["AGE"] - 10000 / 365.0) < 1e-12


def test_sentinel_days_employed_becomes_null(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, -10000, 365243, 0), (2, 1.0, 1.0, -10000, -365, 0)], BASIC)
    out = {r["SK_ID_CURR"]: r for r in clean_and_derive(df).collect()}
    assert out[1]["DAYS_EMPLOYED"] is None and out[1]["EMPLOY_YEARS"] is None
    assert out[2]["EMPLOY_YEARS"] == 1.0


def test_imputation_leaves_no_nulls(spark):
    df = spark.createDataFrame([(1, 100000.0, None, -10000, 0), (2, None, 300000.0, -15000, 1),
                                (3, 200000.0, 400000.0, -20000, 0)],
                               "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, "
                               "DAYS_BIRTH long, TARGET int")
    feats = FeatureModel(list(df.columns), [], None).transform(df)
    prep = PrepModel.fit(feats).transform(feats)
    for c in prep.columns:
        assert prep.where(F.col(c).isNull()).count() == 0, c
    r = {x["SK_ID_CURR"]: x for x in prep.collect()}
    assert r[2]["AMT_INCOME_TOTAL"] == 150000.0           # median of the other two


def test_ratio_features(spark):
    df = spark.createDataFrame([(1, 100000.0, 200000.0, 10000.0, -10000, 0),
                                (2, 150000.0, 300000.0, 15000.0, -15000, 1)],
                               "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, "
                               "AMT_ANNUITY double, DAYS_BIRTH long, TARGET int")
    out = derive_features(df).collect()
    assert all(abs(r["CREDIT_INCOME_RATIO"] - 2.0) < 0.01 for r in out)
    assert all(abs(r["ANNUITY_INCOME_RATIO"] - 0.1) < 0.01 for r in out)


def test_advanced_features(spark):
    df = spark.createDataFrame([(1, 100000.0, 200000.0, 10000.0, -10000, -1000, 0.5, 0.6, 0.7, 0),
                                (2, 150000.0, 300000.0, 15000.0, -15000, -2000, None, 0.5, None, 1),
                                (3, 200000.0, 400000.0, 20000.0, -20000, -3000, 0.7, None, 0.9, 0)],
                               "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, "
                               "AMT_ANNUITY double, DAYS_BIRTH long, DAYS_EMPLOYED long, "
                               "EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double, TARGET int")
    out = {r["SK_ID_CURR"]: r for r in derive_features(df, [100000.0, 125000.0, 150000.0, 175000.0, 200000.0]).collect()}
    for c in ["CREDIT_INCOME_RATIO_SQ", "CREDIT_INCOME_RATIO_SQRT", "ANNUITY_INCOME_RATIO_SQ",
              "AGE_EMPLOY_INTERACTION", "AGE_EMPLOY_RATIO", "AMT_INCOME_TOTAL_LOG", "AMT_CREDIT_LOG",
              "AMT_ANNUITY_LOG", "EXT_SOURCES_STD", "TOTAL_AMOUNT", "WEIGHTED_CREDIT_SCORE", "BIRTH_YEAR"]:
        assert c in out[1].asDict()
    assert abs(out[1]["EXT_SOURCES_MEAN"] - 0.6) < 1e-12
    assert abs(out[1]["EXT_SOURCES_STD"] - 0.1) < 1e-12      # sample std of .5 .6 .7
    assert out[2]["EXT_SOURCES_STD"] is None                  # one value: no sample std
    assert out[2]["EXT_SOURCES_MAX"] == 0.5 and out[2]["EXT_SOURCES_MIN"] == 0.5
    assert abs(out[1]["AMT_INCOME_TOTAL_LOG"] - math.log1p(100000.0)) < 1e-12
    assert out[1]["BIRTH_YEAR"] == int(10000 / 365.25) + 2024


def test_binning(spark):
    df = spark.createDataFrame([(1, 50000.0, -9000, 0), (2, 100000.0, -12000, 1), (3, 200000.0, -15000, 0),
                                (4, 300000.0, -18000, 1), (5, 500000.0, -20000, 0)],
                               "SK_ID_CURR long, AMT_INCOME_TOTAL double, DAYS_BIRTH long, TARGET int")
    fm = FeatureModel.fit(df)
    out = fm.transform(df).collect()
    assert all(0 <= r["AGE_BINNED"] <= 4 for r in out)
    assert all(0 <= r["INCOME_BINNED"] <= 3 for r in out)
    assert fm.income_quartiles == [50000.0, 100000.0, 200000.0, 300000.0, 500000.0]
    assert [r["INCOME_BINNED"] for r in sorted(out, key=lambda r: r["SK_ID_CURR"])] == [0.0, 0.0, 1.0, 2.0, 3.0]


def test_all_null_column_is_dropped(spark):
    df = spark.createDataFrame([(1, None, 200000.0, 0), (2, None, 300000.0, 1), (3, None, 400000.0, 0)],
                               "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, TARGET int")
    fm = FeatureModel.fit(df)
    assert "AMT_INCOME_TOTAL" in fm.dropped
    out = fm.transform(df)
    assert "AMT_INCOME_TOTAL" not in out.columns and "CREDIT_INCOME_RATIO" not in out.columns


def test_exactly_forty_percent_nulls_is_kept(spark):
    rows = [(i, None if i < 2 else float(i), 0) for i in range(5)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, AMT_CREDIT double, TARGET int")
    assert "AMT_CREDIT" in FeatureModel.fit(df).kept


def test_zero_income_gives_null_ratio(spark):
    df = spark.createDataFrame([(1, 0.0, 200000.0, 0), (2, 100000.0, 300000.0, 1)],
                               "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, TARGET int")
    out = {r["SK_ID_CURR"]: r for r in derive_features(df).collect()}
    assert out[1]["CREDIT_INCOME_RATIO"] is None
    assert out[2]["CREDIT_INCOME_RATIO"] == 3.0


def test_codes_of_many_categories(spark):
    """200,000 distinct values and one in a third of the rows: dense codes in sorted order, as a table."""
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.hex(F.xxhash64("id")))).alias("a"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("b"))
    codes = fit_category_codes(df, ["a", "b"])
    got = {n: sorted((r["value"], r["code"]) for r in codes.where(F.col("name") == n).collect()) for n in ("a", "b")}
    assert len(got["a"]) == 200_001 and [c for _, c in got["a"]] == list(range(200_001))
    assert got["b"] == [(v, i) for i, v in enumerate(["MISSING", "k0", "k1", "k2", "k3", "k4"])]
    pm = PrepModel([], {}, ["a", "b"], codes, {}, ["a", "b"])
    out = pm.transform(df.withColumn("row", F.lit(1)), keep=["row"])
    assert out.columns == ["a", "b", "row"] and out.count() == 300_000
    assert out.agg(F.count_distinct("a"), F.max("a"), F.min("a")).first()[:] == (200_001, 200_000, 0)


def test_saved_preparation_is_applied_to_a_later_batch(spark, tmp_path):
    fit = spark.createDataFrame([(i, float(10 * i), float(i) if i % 4 else None, "abc"[i % 3] if i % 5 else None, i % 2) for i in range(40)],
                                "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, CODE_GENDER string, TARGET int")
    known = Preparation.fit(fit)
    known.save(str(tmp_path / "prep"))
    loaded = Preparation.load(spark, str(tmp_path / "prep"))
    assert loaded.transform(fit).collect() == known.transform(fit).collect()
    # later: a column is missing, one is new, values are far off or unknown
    later = spark.createDataFrame([(100, 1e9, "z", 7), (101, None, None, 7), (102, 50.0, "b", 7)],
                                  "SK_ID_CURR long, AMT_INCOME_TOTAL double, CODE_GENDER string, EXTRA int")
    out = {r["SK_ID_CURR"]: r for r in loaded.transform(later).collect()}
    assert loaded.transform(later).columns == known.transform(fit).columns
    assert out[100]["AMT_INCOME_TOTAL"] == known.prep.caps["AMT_INCOME_TOTAL"][1]
    assert out[101]["AMT_INCOME_TOTAL"] == known.prep.medians["AMT_INCOME_TOTAL"]
    assert [out[i]["CODE_GENDER"] for i in (100, 101, 102)] == [-1, 0, 2]   # MISSING, a, b, c
    assert all(r["AMT_CREDIT"] == 0.0 and r["CREDIT_INCOME_RATIO"] == 0.0 and r["TARGET"] == 0.0 for r in out.values())


def test_later_batch_joins_the_applicants_once(spark):
    from __spark_entry__ import queries
    from conftest import SF_SMALL
    for name in ("prepared_later_batch", "prepared_unlike_batch"):
        read = queries()[name](spark, SF_SMALL).inputFiles()
        assert read and not [f for f in read if "lineitem" in f or "orders" in f]
