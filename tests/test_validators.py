"""Record, frame and range validation (reference's validator tests)."""
from riskspark.functions.scores import api_feature_vector
from riskspark.operators.quality import batch_summary, check_records, frame_checks, range_checks, batch_size

REQ = ("SK_ID_CURR long, amt_income_total double, amt_credit double, amt_annuity double, "
       "cnt_children long, ext_source_2 double, ext_source_3 double, age double, employ_years double")


def test_good_and_bad_records(spark):
    df = spark.createDataFrame([(1, 200000.0, 400000.0, 25000.0, 0, 0.5, 0.6, 35.0, 5.0),
                                (2, -100.0, 400000.0, 25000.0, 0, 0.5, 0.6, 35.0, 5.0),
                                (3, 200000.0, 400000.0, 25000.0, None, None, None, 17.0, None)], REQ)
    out = {r["SK_ID_CURR"]: r for r in check_records(df).collect()}
    assert out[1]["accepted"] and out[1]["failed_rules"] == ""
    assert not out[2]["accepted"] and out[2]["failed_rules"] == "amt_income_total"
    assert out[3]["failed_rules"] == "age"
    s = batch_summary(check_records(df)).first()
    assert (s["n_records"], s["n_accepted"], s["n_rejected"]) == (3, 1, 2)


def test_api_vector_defaults(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, None, 0.0, None, 40.0, None)], REQ)
    r = api_feature_vector(df).first()
    assert r["EXT_SOURCE_2"] == 0.5 and r["EXT_SOURCE_3"] == 0.5
    assert r["CNT_CHILDREN"] == 0.0 and r["EMPLOY_YEARS"] == 0.0


def test_frame_checks(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a long, b long")
    got = {r["column"]: tuple(r)[1:] for r in frame_checks(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (True, 2, 2, True), "b": (True, 2, 0, False), "c": (False, 2, 0, False)}
    assert not any(r["usable"] for r in frame_checks(df.limit(0), ["a"]).collect())


def test_batch_size(spark):
    df = spark.createDataFrame([(1,), (2,)], "a long")
    assert batch_size(df).first()["within"] and not batch_size(df.limit(0)).first()["within"] and not batch_size(df, most=1).first()["within"]


def test_range_rule(spark):
    df = spark.createDataFrame([(25.0,), (30.0,), (35.0,), (40.0,)], "age double")
    assert range_checks(df, {"age": (18, 100)}).first()["valid"]
    r = range_checks(df, {"age": (30, 35)}).first()
    assert not r["valid"] and r["n_below"] == 1 and r["n_above"] == 1
