"""Named queries over the given tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the whole tables and runs one operator (or a short chain of
them) of the library.  Reporting queries round floating results whose value
depends on summation order (sums, means, correlations, logarithms) so that a
second engine can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import scores as S
from riskspark.functions.keys import hash_key
from riskspark.operators import ensemble as N
from riskspark.operators import evaluate as E
from riskspark.operators import profile as A
from riskspark.operators import quality as Q
from riskspark.operators import sampling as B
from riskspark.operators import select as X
from riskspark.operators.explain import attribution, breakdown, linear_shap_summary
from riskspark.operators.prep import Preparation, PrepModel, clean_and_derive, standard_scale
from riskspark.session import stored
from riskspark.sources.tables import applications

Query = Callable[[SparkSession, str], DataFrame]

LOG_COLS = ("AMT_INCOME_TOTAL_LOG", "AMT_CREDIT_LOG", "AMT_ANNUITY_LOG")
MODELS = {"logistic": "p_logistic", "tree": "p_tree", "forest": "p_forest"}


def apps(spark, sf):
    return applications(spark, sf)


def features(spark, sf):
    return clean_and_derive(applications(spark, sf))


def prepared(spark, sf):
    # joined once and written: every pass of the fits and the result read these files
    f = clean_and_derive(stored(applications(spark, sf), "applications"))
    return PrepModel.fit(f).transform(f)


def scored(spark, sf):
    return S.deterministic_scores(applications(spark, sf))


def _long_scores(spark, sf):
    sc = scored(spark, sf)
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score"))
                    for m, c in MODELS.items()])
    return sc.select("TARGET", F.explode(arr).alias("m")).select("m.model", "TARGET", "m.score")


def _r(df: DataFrame, cols, digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


RANGE_RULES = {"AMT_INCOME_TOTAL": (0, None), "AMT_CREDIT": (0, None), "AMT_ANNUITY": (0, None),
               "CNT_CHILDREN": (0, 20), "EXT_SOURCE_2": (0, 1), "EXT_SOURCE_3": (0, 1)}


def _split_model(spark, sf):
    a = apps(spark, sf)
    return a, B.SplitModel.fit(a)


def _train_part(spark, sf):
    a, m = _split_model(spark, sf)
    return m.train(a)


def _later_batch(spark: SparkSession, sf: str, change: Callable) -> DataFrame:
    """The preparation fitted on the training part, saved, loaded again and
    applied to the test part as ``change`` leaves it."""
    import os
    import uuid
    from riskspark.session import checkpoint_dir
    # joined once and written: the split, every pass of the fits and the batch read these files
    a = stored(apps(spark, sf), "applications")
    split = B.SplitModel.fit(a)
    path = os.path.join(checkpoint_dir(spark), "preparation", uuid.uuid4().hex)
    Preparation.fit(split.train(a)).save(path)
    batch = change(split.test(a))
    return _r(Preparation.load(spark, path).transform(batch), [c for c in LOG_COLS], 6)


def _csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The applicant table written as CSV (header, no index) into the shared
    checkpoint folder, then loaded with its schema and the label check."""
    import os
    import uuid
    from riskspark.session import checkpoint_dir
    from riskspark.sources.files import read_applicants, write_scored
    a = apps(spark, sf)
    path = os.path.join(checkpoint_dir(spark), "csv-roundtrip", uuid.uuid4().hex)
    write_scored(a, path, fmt="csv")
    return read_applicants(spark, path, schema=a.schema, require_label=True)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    # sources / sampling
    q["applications"] = apps
    q["sample_rows"] = lambda s, d: B.sample_rows(apps(s, d), 1000)
    q["csv_roundtrip"] = _csv_roundtrip                      # S7 sink, then S1/S8 source
    q["sample_info"] = lambda s, d: B.sample_info(apps(s, d), 1000)
    # quality
    q["range_checks"] = lambda s, d: Q.range_checks(apps(s, d), RANGE_RULES)
    q["record_checks"] = lambda s, d: Q.check_records(S.request_fields(apps(s, d)))
    q["batch_summary"] = lambda s, d: Q.batch_summary(Q.check_records(S.request_fields(apps(s, d))))
    q["frame_checks"] = lambda s, d: Q.frame_checks(apps(s, d), REQUIRED_COLUMNS)                  # Q1
    q["batch_size"] = lambda s, d: Q.batch_size(S.request_fields(apps(s, d)))                        # Q5
    q["null_top"] = lambda s, d: Q.top_null_columns(apps(s, d))
    q["null_limit"] = lambda s, d: Q.kept_columns(apps(s, d))
    q["null_by_target"] = lambda s, d: Q.null_rate_by_label(apps(s, d))
    q["missing_pattern"] = lambda s, d: Q.missing_pattern(apps(s, d))
    q["total_nulls"] = lambda s, d: Q.total_nulls(features(s, d))
    # features / prep
    q["features"] = lambda s, d: _r(features(s, d), LOG_COLS, 6)
    q["prepared"] = lambda s, d: _r(prepared(s, d), LOG_COLS, 6)
    # Fitted on the training part, reused on later rows; a batch without one column, with another and a new category
    q["prepared_later_batch"] = lambda s, d: _later_batch(s, d, lambda t: t)
    q["prepared_unlike_batch"] = lambda s, d: _later_batch(s, d, lambda t: t.drop("AMT_GOODS_PRICE").withColumns(
        {"EXTRA": F.lit(1), "CODE_GENDER": F.when(F.col("SK_ID_CURR") % 3 == 0, "X").otherwise(F.col("CODE_GENDER"))}))
    sc_cols = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CREDIT_INCOME_RATIO", "AGE",
               "EXT_SOURCES_MEAN"]
    q["scaled"] = lambda s, d: _r(standard_scale(prepared(s, d).select("SK_ID_CURR", *sc_cols),
                                                      sc_cols), sc_cols, 6)
    # profiling
    q["overview"] = lambda s, d: A.overview(features(s, d))
    q["label_counts"] = lambda s, d: A.label_counts(apps(s, d))
    q["rate_by_income_type"] = lambda s, d: A.default_rate_by(
        apps(s, d), "NAME_INCOME_TYPE", min_count=A.MIN_GROUP_INCOME_TYPE)
    q["rate_by_organization_top15"] = lambda s, d: A.default_rate_by(
        apps(s, d), "ORGANIZATION_TYPE", min_count=A.MIN_GROUP_ORGANIZATION, top=A.TOP_ORGANIZATIONS)
    q["rate_by_dimension"] = lambda s, d: A.default_rate_by_many(apps(s, d), A.RATE_DIMENSIONS)
    q["rate_by_family_size"] = lambda s, d: A.default_rate_by_family_size(apps(s, d))
    q["rate_by_age_group"] = lambda s, d: A.default_rate_by_age_group(features(s, d))
    q["crosstab_gender"] = lambda s, d: A.crosstab_pct(apps(s, d), "CODE_GENDER")
    q["label_means"] = lambda s, d: _r(A.label_means(features(s, d),
                                                     ["AMT_INCOME_TOTAL", "EXT_SOURCE_2", "AGE"]), ["mean"], 6)
    q["insights"] = lambda s, d: _r(A.insights(features(s, d)), ["non_default", "default", "gap"], 6)
    q["target_correlations"] = lambda s, d: _r(A.target_correlations(features(s, d)), ["corr"], 9)
    q["correlation_matrix"] = lambda s, d: _r(A.correlation_matrix(features(s, d)), ["corr"], 9)
    q["histogram_credit"] = lambda s, d: _r(A.histogram(features(s, d), "AMT_CREDIT", 50),
                                            ["bin_lo", "bin_hi"], 6)
    q["histogram_age_by_label"] = lambda s, d: _r(A.histogram(features(s, d), "AGE", 30, by=["TARGET"]),
                                                  ["bin_lo", "bin_hi"], 6)
    q["box_summary"] = lambda s, d: A.box_summary(features(s, d), ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AGE"])
    q["density_ext_by_label"] = lambda s, d: _r(A.kernel_density(features(s, d), "EXT_SOURCE_2", by=["TARGET"]),
                                                ["x", "bandwidth", "density"], 6)
    q["describe"] = lambda s, d: _r(A.describe(features(s, d)), ["mean", "std"], 6)
    q["scatter_sample"] = lambda s, d: A.scatter_sample(apps(s, d), "AMT_INCOME_TOTAL", "AMT_CREDIT")
    q["scatter_bins"] = lambda s, d: A.scatter_bins(apps(s, d), "AMT_INCOME_TOTAL", "AMT_CREDIT")
    # split / weights
    q["split_rows"] = lambda s, d: (lambda a_m: a_m[1].transform(a_m[0]).select(
        "SK_ID_CURR", "TARGET", "split"))(_split_model(s, d))
    q["split_summary"] = lambda s, d: (lambda a_m: B.split_summary(a_m[1].transform(a_m[0])))(
        _split_model(s, d))
    q["class_weights"] = lambda s, d: B.class_weights(_train_part(s, d))
    q["positive_weight"] = lambda s, d: B.positive_weight(_train_part(s, d))
    # evaluation on deterministic scores
    q["scores"] = scored
    q["metrics"] = lambda s, d: E.classification_metrics(scored(s, d), "TARGET", "p_logistic")
    q["roc_auc"] = lambda s, d: E.roc_auc(scored(s, d), "TARGET", "p_logistic")
    q["roc_curve"] = lambda s, d: E.roc_curve(scored(s, d), "TARGET", "p_logistic")
    q["confusion_matrix"] = lambda s, d: E.confusion_matrix(scored(s, d), "TARGET", "p_logistic")
    q["class_report"] = lambda s, d: E.class_report(scored(s, d), "TARGET", "p_logistic")
    q["threshold_metrics"] = lambda s, d: E.threshold_metrics(scored(s, d), "TARGET", "p_logistic")
    q["best_f1_threshold"] = lambda s, d: E.best_row(
        E.threshold_metrics(scored(s, d), "TARGET", "p_logistic"), "f1_score")
    q["metrics_at_threshold"] = lambda s, d: E.confusion_counts(
        scored(s, d), "TARGET", "p_logistic", 0.35).select(*E.metric_columns(), "tp", "tn", "fp", "fn")
    q["profit_curve"] = lambda s, d: E.profit_curve(scored(s, d), "TARGET", "p_logistic")
    q["best_profit_threshold"] = lambda s, d: E.best_row(
        E.profit_curve(scored(s, d), "TARGET", "p_logistic"), "profit")
    q["cost_breakdown"] = lambda s, d: E.cost_breakdown(E.best_row(
        E.profit_curve(scored(s, d), "TARGET", "p_logistic"), "profit"))
    q["default_vs_best"] = lambda s, d: E.default_vs_best(scored(s, d), "TARGET", "p_logistic")
    q["model_comparison"] = lambda s, d: E.model_comparison(_long_scores(s, d))
    q["best_per_metric"] = lambda s, d: E.best_per_metric(E.model_comparison(_long_scores(s, d)))
    # ensembles
    q["soft_vote"] = lambda s, d: N.soft_vote(scored(s, d), MODELS)
    q["hard_vote"] = lambda s, d: N.hard_vote(scored(s, d), MODELS)
    q["blend"] = lambda s, d: N.blend(scored(s, d), MODELS)
    q["blend_weight_auc"] = lambda s, d: N.blend_weight_auc(scored(s, d), "p_logistic", "p_tree")
    q["ensemble_metrics"] = lambda s, d: E.classification_metrics(
        N.soft_vote(scored(s, d), MODELS), "TARGET", "p_soft")
    # bands / API fields
    q["risk_bands"] = lambda s, d: scored(s, d).select(
        "SK_ID_CURR", "p_logistic", S.band_batch(F.col("p_logistic")).alias("band_batch"),
        S.band_api(F.col("p_logistic")).alias("band_api"),
        S.band_two_level(F.col("p_logistic")).alias("band_two_level"))
    q["band_counts"] = lambda s, d: _band_counts(scored(s, d))
    q["api_features"] = lambda s, d: S.api_feature_vector(S.request_fields(apps(s, d)))
    # selection
    q["anova_f"] = lambda s, d: _r(_anova(s, d), ["f_score"], 6)
    q["k_best"] = lambda s, d: _r(X.k_best(_anova(s, d)), ["f_score"], 6)
    q["mutual_info"] = lambda s, d: _r(_mi(s, d), ["mutual_info"], 9)
    # explanation on the deterministic linear model
    q["linear_shap_summary"] = lambda s, d: _r(_shap(s, d), ["mean_abs_shap"], 9)
    q["linear_shap_breakdown"] = lambda s, d: _r(breakdown(attribution(*_linear(s, d))), ["base", "logit", "value", "part"], 9)
    return q


REQUIRED_COLUMNS = ("SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "EXT_SOURCE_1", "NAME_HOUSING_TYPE")


def _band_counts(sc: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    g = sc.groupBy(S.band_batch(F.col("p_logistic")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy()))


def _anova(s, d):
    p = prepared(s, d)
    return X.anova_f(p, X.feature_columns(p))


def _mi(s, d):
    p = prepared(s, d)
    return X.mutual_information(p, X.feature_columns(p))


def _linear(s, d):
    """Rows, background and coefficients of the deterministic linear model."""
    a = apps(s, d)
    lin = a.select("SK_ID_CURR", (S.credit_income_capped() / 10).alias("credit_ratio_capped"),
                   F.coalesce(F.col("EXT_SOURCE_2"), F.lit(0.5)).alias("ext_source_2_filled"))
    return lin, lin, {"credit_ratio_capped": 0.8, "ext_source_2_filled": -1.5}


def _shap(s, d):
    return linear_shap_summary(*_linear(s, d))
