"""Queries that train models (no SQL oracle: rows-only checks + property tests).

Every query trains on the training part of the stratified split of the
whole ``applications`` table and scores the whole test part.  The prepared
and split frames are built once per (session, data folder) and persisted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions.scores import api_feature_vector, request_fields
from riskspark.operators import evaluate as E
from riskspark.operators import explain as X
from riskspark.operators import select as SEL
from riskspark.operators.models import train
from riskspark.operators.neighbors import KNNIndex, knn_classify, smote, smote_balance
from riskspark.operators.prep import ScalerModel
from riskspark.operators.quality import check_records
from riskspark.operators.score import band_counts, batch_score, what_if
from riskspark.operators.tune import (grid_search_logistic, stack, stacking_vs_base)
from riskspark.plans.training import Workbench, compare, workbench

_WB: dict = {}


def _wb(spark: SparkSession, sf: str) -> Workbench:
    k = (spark.sparkContext.applicationId, sf)
    if k not in _WB:
        _WB[k] = workbench(spark, sf)
    return _WB[k]


def _scored_test(spark, sf, preset):
    wb = _wb(spark, sf)
    m = train(wb.train, wb.features, preset)
    return m.score(wb.test).select("SK_ID_CURR", "TARGET", f"p_{m.name}", f"pred_{m.name}")


def _raw_test(spark, sf) -> DataFrame:
    wb = _wb(spark, sf)
    return wb.split.test(wb.applications)


# What-if scenarios (field overrides) used by the registered query.
WHAT_IF_SCENARIOS = [
    {},                                            # the row as it is
    {"AMT_INCOME_TOTAL": 200000.0},
    {"AMT_CREDIT": 400000.0, "AMT_ANNUITY": 25000.0},
    {"EXT_SOURCE_2": 0.2, "EXT_SOURCE_3": 0.2},
    {"AGE": 35.0, "EMPLOY_YEARS": 5.0},
]


def model_queries() -> dict:
    q = {}
    # M1-M5, M7, M8: probabilities and 0/1 predictions of the test part
    for preset in ("logistic", "tree", "forest", "xgboost", "lightgbm"):
        q[f"model_{preset}"] = (lambda p: lambda s, d: _scored_test(s, d, p))(preset)
    q["model_research_baselines"] = lambda s, d: _research(s, d)
    # E6 + E11 with trained models (the flagship)
    q["trained_comparison"] = lambda s, d: (lambda wb: compare(
        [train(wb.train, wb.features, "logistic"), train(wb.train, wb.features, "tree")], wb.test))(_wb(s, d))
    # R1 / R5 / R7
    q["batch_score"] = lambda s, d: _batch(s, d)
    q["batch_band_counts"] = lambda s, d: band_counts(_batch(s, d))
    q["what_if"] = lambda s, d: _what_if(s, d)
    # X4-X9, X11
    q["logistic_coefficients"] = lambda s, d: _coefs(s, d)
    q["tree_importance"] = lambda s, d: _tree_importance(s, d)
    q["forest_importance_selection"] = lambda s, d: _forest_importance(s, d).limit(20)
    q["feature_ranking"] = lambda s, d: _ranking(s, d)
    q["top_features"] = lambda s, d: SEL.top_n(_ranking(s, d), 20)
    q["selection_compare"] = lambda s, d: _selection_compare(s, d)
    q["partial_dependence"] = lambda s, d: _pdp(s, d)
    # T1, N3, N4
    q["cv_logistic"] = lambda s, d: (lambda wb: grid_search_logistic(wb.train, wb.features).cv_table)(_wb(s, d))
    q["stacking_vs_base"] = lambda s, d: _stacking(s, d)
    # R6 model on the eight API fields (the scoring service's model)
    q["api_model_scores"] = lambda s, d: _api_scores(s, d)
    # M6: k-NN (k=5) on the scaled features, exact, whole training part
    q["model_knn"] = lambda s, d: _knn(s, d)
    q["knn_neighbours"] = lambda s, d: _knn_neighbours(s, d)
    # SMOTE on the training part, and the logistic model trained on it
    q["smote_balance"] = lambda s, d: smote_balance(_smote(s, d))
    q["model_logistic_smote"] = lambda s, d: _smote_logistic(s, d)
    # Registry of the trained logistic model and its test metrics
    q["registry_models"] = lambda s, d: _registry(s, d).list_models().drop("path", "created")
    q["registry_latest_scores"] = lambda s, d: _registry_scores(s, d)
    q["registry_latest_metrics"] = lambda s, d: _registry(s, d).latest_metrics().drop("ts")
    # The scoring service as a Structured Streaming job over request files
    q["stream_scores"] = lambda s, d: _stream(s, d)
    q["prediction_time"] = lambda s, d: _prediction_time(s, d)      # R14
    return q


def _research(s, d):
    wb = _wb(s, d)
    a = train(wb.train, wb.features, "logistic_research")
    b = train(wb.train, wb.features, "tree_research")
    return b.score(a.score(wb.test)).select("SK_ID_CURR", "TARGET", "p_logistic_research",
                                             "pred_logistic_research", "p_tree_research",
                                             "pred_tree_research")


def _batch(s, d):
    wb = _wb(s, d)
    m = train(wb.train, wb.features, "logistic")
    return batch_score(_raw_test(s, d), wb.feature_model, wb.prep_model, m)


def _what_if(s, d):
    wb = _wb(s, d)
    m = train(wb.train, wb.features, "logistic")
    return what_if(_raw_test(s, d), WHAT_IF_SCENARIOS, wb.feature_model, wb.prep_model, m)


def _coefs(s, d):
    wb = _wb(s, d)
    m = train(wb.train, wb.features, "logistic")
    t = X.coefficient_table(s, m.features, m.classifier.coefficients.toArray())
    top, bottom = X.top_coefficients(t)
    return top.withColumn("side", F.lit("largest")).unionByName(bottom.withColumn("side", F.lit("smallest")))


def _tree_importance(s, d):
    wb = _wb(s, d)
    m = train(wb.train, wb.features, "tree")
    return X.importance_table(s, m.features, m.classifier.featureImportances).limit(X.TOP_IMPORTANCES)


_IMPORTANCE: dict = {}


def _forest_importance(s, d):
    """Importances of the selection forest, trained once per session and
    data folder (one value per feature is kept)."""
    k = (s.sparkContext.applicationId, d)
    if k not in _IMPORTANCE:
        wb = _wb(s, d)
        m = train(wb.train, wb.features, "forest_select")
        _IMPORTANCE[k] = (m.features, m.classifier.featureImportances.toArray().tolist())
    names, vals = _IMPORTANCE[k]
    return X.importance_table(s, names, vals)


def _ranking(s, d):
    wb = _wb(s, d)
    f = SEL.anova_f(wb.train, wb.features)
    mi = SEL.mutual_information(wb.train, wb.features)
    rf = _forest_importance(s, d).withColumnRenamed("importance", "rf_importance")
    scores = f.join(mi, "feature").join(rf, "feature")     # one row per feature each
    return SEL.combined_ranking(scores)


def _selection_compare(s, d):
    wb = _wb(s, d)
    kb = SEL.k_best(SEL.anova_f(wb.train, wb.features))
    # both selections hold at most k rows: a global window over them is bounded
    kb = kb.withColumn("rank", F.row_number().over(Window.orderBy(F.col("f_score").desc(), "feature")))
    rf = _forest_importance(s, d).limit(20)
    rf = rf.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
    return SEL.compare_selections(kb.select("feature", "rank"), rf.select("feature", "rank"))


def _pdp(s, d):
    wb = _wb(s, d)
    m = train(wb.train, wb.features, "logistic")
    return X.partial_dependence(m, wb.train, "AGE")


def _stacking(s, d):
    wb = _wb(s, d)
    model, _ = stack(wb.train, wb.features, base_presets=("logistic", "forest_stack", "xgboost_stack"))
    return stacking_vs_base(model, wb.test)


def _api_model(s, d):
    wb = _wb(s, d)
    req = check_records(request_fields(wb.applications, keep=["TARGET"])).where("accepted")
    api = api_feature_vector(req, keep=["TARGET"])
    cols = [c for c in api.columns if c not in ("SK_ID_CURR", "TARGET")]
    return train(wb.split.train(api), cols, "logistic", name="api")


def _stream(s, d):
    from riskspark.streaming.scoring import read_sink
    _, sink = _run_stream(s, d)
    return read_sink(s, sink).drop("batch_id")


def _prediction_time(s, d):
    """Average seconds per scoring micro-batch, over all batches."""
    from riskspark.operators.registry import average_prediction_time
    from riskspark.streaming.scoring import progress_table
    _, sink = _run_stream(s, d)
    return average_prediction_time(progress_table(s, sink))


def _run_stream(s, d):
    import os
    import uuid
    from riskspark.session import checkpoint_dir
    from riskspark.streaming.scoring import start_scoring_stream
    wb = _wb(s, d)
    model = _api_model(s, d)
    run = os.path.join(checkpoint_dir(s), "stream-scores", uuid.uuid4().hex)
    src, sink, ckpt = (os.path.join(run, x) for x in ("requests", "scored", "checkpoint"))
    # arriving requests: the test part's request fields, as several files
    wb.split.test(request_fields(wb.applications)).repartition(4).write.parquet(src)
    q = start_scoring_stream(s, src, model, sink, ckpt)
    q.awaitTermination()
    return q, sink


def _api_scores(s, d):
    wb = _wb(s, d)
    # the service scores only records that pass the request rules (Q3/Q4)
    req = check_records(request_fields(wb.applications, keep=["TARGET"])).where("accepted")
    api = api_feature_vector(req, keep=["TARGET"])
    cols = [c for c in api.columns if c not in ("SK_ID_CURR", "TARGET")]
    tr, te = wb.split.train(api), wb.split.test(api)
    m = train(tr, cols, "logistic", name="api")
    return m.score(te).select("SK_ID_CURR", "TARGET", "p_api", "pred_api")


def _scaled_parts(s, d):
    """Training and test parts scaled by the training part's statistics
    (the research notebook's StandardScaler before k-NN)."""
    wb = _wb(s, d)
    sm = ScalerModel.fit(wb.train, wb.features)
    return wb, sm.transform(wb.train), sm.transform(wb.test)


def _knn(s, d):
    wb, tr, te = _scaled_parts(s, d)
    return knn_classify(tr, te, wb.features, k=5)


def _knn_neighbours(s, d):
    wb, tr, te = _scaled_parts(s, d)
    nn = KNNIndex(tr, wb.features).neighbours(te, k=5)
    return nn.withColumn("distance", F.round("distance", 6))


_SMOTE: dict = {}


def _smote(s, d):
    """The SMOTE-balanced training part, built once per session and data folder."""
    k = (s.sparkContext.applicationId, d)
    if k not in _SMOTE:
        wb = _wb(s, d)
        _SMOTE[k] = smote(wb.train, wb.features)
    return _SMOTE[k]


def _smote_logistic(s, d):
    wb = _wb(s, d)
    m = train(_smote(s, d), wb.features, "logistic", name="logistic_smote")
    return m.score(wb.test).select("SK_ID_CURR", "TARGET", "p_logistic_smote", "pred_logistic_smote")


_REG: dict = {}


def _registry(s, d):
    """A registry under the shared folder holding the logistic model trained
    on the training part, with its metrics on the test part (R9, R13)."""
    k = (s.sparkContext.applicationId, d)
    if k not in _REG:
        import os
        import uuid
        from riskspark.operators.registry import ModelRegistry
        from riskspark.session import checkpoint_dir
        wb = _wb(s, d)
        m = train(wb.train, wb.features, "logistic")
        row = E.classification_metrics(m.score(wb.test), "TARGET", "p_logistic").first()
        metrics = {c: row[c] for c in ("roc_auc", "accuracy", "precision", "recall", "f1_score")}
        reg = ModelRegistry(s, root=os.path.join(checkpoint_dir(s), "registry", uuid.uuid4().hex))
        reg.save(m, metrics)
        _REG[k] = reg
    return _REG[k]


def _registry_scores(s, d):
    """R11 + R12: the latest registered model, loaded back, scores the test part."""
    m = _registry(s, d).load()
    return m.score(_wb(s, d).test).select("SK_ID_CURR", "TARGET", "p_logistic", "pred_logistic")
