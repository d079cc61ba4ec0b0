"""Models, ensembles, scoring, registry and streaming (reference's model and
ensemble tests as properties)."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskspark.operators import ensemble as N
from riskspark.operators import evaluate as E
from riskspark.operators.models import score_all, train
from riskspark.operators.registry import ModelRegistry
from riskspark.operators.score import batch_score, what_if
from riskspark.operators.tune import grid_search_logistic, stack, stacking_vs_base
from riskspark.plans.training import compare, workbench


@pytest.fixture(scope="module")
def wb(spark):
    w = workbench(spark, SF_SMALL)
    yield w
    w.release()


@pytest.fixture(scope="module")
def models(wb):
    return [train(wb.train, wb.features, p) for p in ("logistic_fast", "tree_fast", "forest_fast")]


def test_probabilities_and_auc(wb, models):
    sc = score_all(models, wb.test)
    assert sc.count() == wb.test.count()
    for m in models:
        bad = sc.where((F.col(f"p_{m.name}") < 0) | (F.col(f"p_{m.name}") > 1)).count()
        assert bad == 0
        auc = E.roc_auc(sc, "TARGET", f"p_{m.name}").first()["roc_auc"]
        assert auc > 0.6, (m.name, auc)


def test_training_is_repeatable(wb):
    a = train(wb.train, wb.features, "logistic_fast").score(wb.test).select("SK_ID_CURR", "p_logistic")
    b = train(wb.train, wb.features, "logistic_fast").score(wb.test).select("SK_ID_CURR", "p_logistic")
    assert a.exceptAll(b).count() == 0


def test_comparison_table(wb, models):
    cmp_ = {r["model"]: r for r in compare(models, wb.test).collect()}
    assert set(cmp_) == {"logistic", "tree", "forest"}
    assert all(r["roc_auc"] > 0.5 and r["best_profit"] is not None for r in cmp_.values())


def test_gbt_preset_trains(wb):
    m = train(wb.train, wb.features, "xgboost_fast")
    assert E.roc_auc(m.score(wb.test), "TARGET", "p_xgboost").first()["roc_auc"] > 0.6


def test_votes_and_blend(wb, models):
    sc = score_all(models, wb.test)
    cols = {m.name: f"p_{m.name}" for m in models}
    soft = N.soft_vote(sc, cols).select("p_soft", *cols.values()).collect()
    w = [0.3 / 0.7, 0.2 / 0.7, 0.2 / 0.7]
    for r in soft[:50]:
        exp = r["p_logistic"] * w[0] + r["p_tree"] * w[1] + r["p_forest"] * w[2]
        assert abs(r["p_soft"] - exp) < 1e-12
    hard = N.hard_vote(sc, cols, use_weights=False).select("pred_hard", *cols.values()).collect()
    for r in hard[:50]:
        votes = sum(1 for c in cols.values() if r[c] >= 0.5)
        assert r["pred_hard"] == (1 if votes >= 1.5 else 0)
    bl = N.blend(sc, {"logistic": "p_logistic", "tree": "p_tree"}).select("p_blend", "p_logistic", "p_tree").first()
    assert abs(bl["p_blend"] - (bl["p_logistic"] + bl["p_tree"]) / 2) < 1e-12
    aucs = N.blend_weight_auc(sc, "p_logistic", "p_tree").collect()
    assert len(aucs) == 11


def test_batch_score_and_what_if(spark, wb, models):
    from riskspark.sources.tables import applications
    raw = wb.split.test(applications(spark, SF_SMALL))
    out = batch_score(raw, wb.feature_model, wb.prep_model, models[0])
    assert out.count() == raw.count()
    assert set(out.columns) >= set(raw.columns) | {"probability", "prediction", "risk_band"}
    assert {r["risk_band"] for r in out.select("risk_band").distinct().collect()} <= {"Low", "Medium", "High"}
    wi = what_if(raw.limit(5), [{}, {"AMT_INCOME_TOTAL": 1.0}], wb.feature_model, wb.prep_model, models[0])
    assert wi.count() == 10


def test_cross_validation_logistic(wb):
    res = grid_search_logistic(wb.train, wb.features, c_values=[0.1, 1.0], max_iter=20, folds=2)
    assert res.best_params["C"] in (0.1, 1.0) and 0.5 < res.best_cv_auc <= 1.0
    assert res.cv_table.count() == 2


def test_stacking(wb):
    model, oof = stack(wb.train, wb.features, base_presets=("logistic_fast", "tree_fast"), folds=2)
    assert oof.count() == wb.train.count()
    t = {r["model"]: r for r in stacking_vs_base(model, wb.test).collect()}
    assert set(t) == {"logistic", "tree", "stacking"} and t["stacking"]["roc_auc"] > 0.5


def test_registry_roundtrip(spark, wb, models):
    reg = ModelRegistry(spark, root=tempfile.mkdtemp(prefix="reg-", dir="/tmp"))
    v1 = reg.save(models[0], {"roc_auc": 0.7, "accuracy": 0.9})
    v2 = reg.save(models[1], {"roc_auc": 0.6})
    assert reg.list_models().count() == 2
    assert reg.latest_version() == v2
    m = reg.load(v1)
    a = models[0].score(wb.test).select("SK_ID_CURR", "p_logistic")
    b = m.score(wb.test).select("SK_ID_CURR", "p_logistic")
    assert a.exceptAll(b).count() == 0
    latest = {r["metric"]: r["value"] for r in reg.latest_metrics().collect()}
    assert latest["roc_auc"] == 0.6 and latest["accuracy"] == 0.9


def test_streaming_equals_batch(spark, wb):
    from riskspark.functions.scores import api_feature_vector, request_fields
    from riskspark.operators.quality import check_records
    from riskspark.sources.tables import applications
    from riskspark.streaming.scoring import read_sink, scored_requests, start_scoring_stream
    apps = applications(spark, SF_SMALL)
    req = check_records(request_fields(apps, keep=["TARGET"])).where("accepted")
    api = api_feature_vector(req, keep=["TARGET"])
    cols = [c for c in api.columns if c not in ("SK_ID_CURR", "TARGET")]
    model = train(wb.split.train(api), cols, "logistic_fast", name="api")
    run = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src = os.path.join(run, "requests")
    test_req = wb.split.test(request_fields(apps))
    test_req.repartition(3).write.parquet(src)
    q = start_scoring_stream(spark, src, model, os.path.join(run, "out"), os.path.join(run, "ckpt"))
    q.awaitTermination()
    streamed = read_sink(spark, os.path.join(run, "out")).drop("batch_id")
    batch = scored_requests(test_req, model)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_random_searches_small_space(wb):
    from riskspark.operators.tune import random_search_forest, random_search_gbt
    rf = random_search_forest(wb.train, wb.features, space={"n_estimators": [5, 10], "max_depth": [3],
                                                           "min_samples_split": [2]}, folds=2)
    assert rf.cv_table.count() == 2 and rf.best_params["n_estimators"] in (5, 10)
    gb = random_search_gbt(wb.train, wb.features, space={"n_estimators": [3], "max_depth": [2, 3],
                                                         "learning_rate": [0.3]}, n_iter=1, folds=2)
    assert gb.cv_table.count() == 1


def test_registry_queries_match_trained_model(spark):
    from riskspark.plans.modeling import model_queries
    q = model_queries()
    direct = q["model_logistic"](spark, SF_SMALL)
    loaded = q["registry_latest_scores"](spark, SF_SMALL)
    assert direct.count() == loaded.count() > 0
    assert direct.exceptAll(loaded).count() == 0
    listed = q["registry_models"](spark, SF_SMALL).collect()
    assert len(listed) == 1 and listed[0]["model_type"] == "LogisticRegressionModel"
    latest = {r["metric"] for r in q["registry_latest_metrics"](spark, SF_SMALL).collect()}
    assert latest == {"roc_auc", "accuracy", "precision", "recall", "f1_score"}


def test_training_part_does_not_follow_the_shuffle_partitions(spark):
    """Iterations run a task per part: parts are cut by size, not one per shuffle partition."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert workbench(spark, SF_SMALL, persist=False).applications.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_deep_forest_passes_over_the_rows_seldom():
    from riskspark.operators.models import PRESETS, _estimator
    for preset in ("forest", "forest_select", "forest_stack"):
        est = _estimator(PRESETS[preset], "features", "TARGET", None, 40, 1.0)
        assert est.getCacheNodeIds() and est.getMaxMemoryInMB() >= 512
        assert (est.getNumTrees(), est.getMaxDepth()) == (PRESETS[preset]["n_trees"], PRESETS[preset]["max_depth"])


def test_prepared_joins_the_applicants_once(spark):
    from riskspark.plans.catalog import prepared
    files = prepared(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any(name in f for f in files for name in ("lineitem.parquet", "orders.parquet"))


def test_partial_dependence_expands_margins_only(wb, models):
    """A logistic model's rows are added up before the grid, with the values of
    scoring each row at each grid value; other models are scored as they are."""
    from riskspark.operators.explain import partial_dependence
    few = wb.train.limit(40).cache()
    for m in models[:2]:
        got = partial_dependence(m, few, "AGE", 4)
        assert ("UDF" in got._jdf.queryExecution().toString()) == (m.name == "tree")
        for r in got.collect():
            p = m.score(few.withColumn("AGE", F.lit(r["grid_value"]))).agg(F.avg(f"p_{m.name}")).first()[0]
            assert r["mean_probability"] == pytest.approx(p, abs=1e-12)
    with pytest.raises(Exception, match="null or NaN"):
        partial_dependence(models[0], few.withColumn("AMT_CREDIT", F.lit(None).cast("double")), "AGE", 4).collect()
    assert partial_dependence(models[0], few.withColumn("AGE", F.lit(30.0)), "AGE", 4).count() == 1


def test_large_tables_are_fitted_one_model_at_a_time(spark, monkeypatch):
    """Every fit of a large table keeps its own blocks of rows: the fits do not share the memory."""
    from riskspark.operators import tune
    given = []
    one = tune.CrossValidator
    monkeypatch.setattr(tune, "CrossValidator", lambda **kw: given.append(kw["parallelism"]) or one(**kw))
    rows = [(i, i % 2, float(i % 7), float(i * i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, a double, b double")
    tables = []
    for most in (60, 59):
        monkeypatch.setattr(tune, "ROWS_AT_ONCE", most, raising=False)
        tables.append(sorted(map(tuple, grid_search_logistic(df, ["a", "b"], c_values=[0.1, 1.0], max_iter=5).cv_table.collect())))
    assert given == [4, 1] and tables[0] == tables[1]
