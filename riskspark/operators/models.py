"""Classifiers on Spark ML (M1-M8) and scoring.

Every model is a ``PipelineModel``: ``VectorAssembler`` over the prepared
feature columns, then the estimator.  Training and scoring run on the
executors; nothing is collected.  Scores are attached to the input rows by
key (``p_<model>`` = probability of class 1, ``pred_<model>`` = p >= t).

Presets hold the reference's settings; the ``*_fast`` presets are smaller
versions for tests and local benchmarks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.prep import KEY, LABEL, ScalerModel
from riskspark.operators.sampling import with_class_weight

SEED = 42

# Model settings of the reference (M1-M5, M7).
PRESETS: dict[str, dict] = {
    "logistic": dict(kind="logistic", C=0.1, max_iter=500, weights="balanced", scaled=True),
    "tree": dict(kind="tree", max_depth=10, min_leaf=20, weights="balanced"),
    "forest": dict(kind="forest", n_trees=200, max_depth=12, min_leaf=20, weights="balanced"),
    "xgboost": dict(kind="gbt", n_iter=300, max_depth=6, step=0.05, subsample=0.8,
                    colsample=0.8, weights="positive"),
    "lightgbm": dict(kind="gbt", n_iter=300, max_depth=6, step=0.05, subsample=0.8,
                     colsample=0.8, weights="positive"),
    "logistic_research": dict(kind="logistic", C=1.0, max_iter=200, weights=None, scaled=True),
    "tree_research": dict(kind="tree", max_depth=6, min_leaf=1, weights=None),
}
# The stacking page's own estimators (used when no trained
# model is given): meta logistic with library defaults, forest of 100 trees,
# boosted trees of 100 rounds with library defaults.
PRESETS.update({
    "logistic_meta": dict(kind="logistic", C=1.0, max_iter=100, weights=None),
    "forest_stack": dict(kind="forest", n_trees=100, max_depth=30, min_leaf=1, weights=None),
    "xgboost_stack": dict(kind="gbt", n_iter=100, max_depth=6, step=0.3, subsample=1.0,
                          colsample=1.0, weights=None),
    "forest_select": dict(kind="forest", n_trees=100, max_depth=30, min_leaf=1, weights=None),
})
# Tuning value of forests: MB of node statistics that a task gathers in one pass.
# A deep forest has more open nodes than the default of 256 holds, and every group of them
# is a pass over the rows; with the rows' node ids kept, no pass walks a tree from its root.
PASS_MB = 512
# Smaller versions of the same models for tests and local runs.
FAST = {
    "logistic_fast": dict(PRESETS["logistic"], max_iter=50),
    "tree_fast": dict(PRESETS["tree"], max_depth=5),
    "forest_fast": dict(PRESETS["forest"], n_trees=20, max_depth=6),
    "xgboost_fast": dict(PRESETS["xgboost"], n_iter=20, max_depth=4, step=0.2),
}
PRESETS.update(FAST)


@dataclass
class TrainedModel:
    name: str
    model: PipelineModel | None
    features: list[str]
    scaler: ScalerModel | None = None
    params: dict = field(default_factory=dict)

    def inputs(self, df: DataFrame) -> DataFrame:
        """Add the model's input columns (scaled copies ``_s_<c>`` when the
        model was trained on standardised features)."""
        if not self.scaler:
            return df
        return df.withColumns({f"_s_{c}": (F.col(c) - F.lit(self.scaler.means[c]))
                               / F.lit(self.scaler.stds[c]) for c in self.features})

    def score(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Attach ``p_<name>`` and ``pred_<name>`` (M8) to the rows."""
        out = self.model.transform(self.inputs(df))
        p = vector_to_array(F.col("probability"))[1]
        return out.select(*[F.col(c) for c in df.columns], p.alias(f"p_{self.name}"),
                          (p >= threshold).cast("int").alias(f"pred_{self.name}"))

    @property
    def classifier(self):
        return self.model.stages[-1]


def _estimator(cfg: dict, features_col: str, label: str, weight_col: str | None,
               n_features: int, sum_weights: float):
    k = cfg["kind"]
    w = {"weightCol": weight_col} if weight_col else {}
    if k == "logistic":
        # scikit-learn's C multiplies the summed loss; Spark averages it:
        # regParam = 1 / (C * sum of weights), L2, no internal standardization
        return LogisticRegression(featuresCol=features_col, labelCol=label,
                                  regParam=1.0 / (cfg["C"] * sum_weights), elasticNetParam=0.0,
                                  maxIter=cfg["max_iter"], standardization=False, **w)
    if k == "tree":
        return DecisionTreeClassifier(featuresCol=features_col, labelCol=label,
                                      maxDepth=cfg["max_depth"], minInstancesPerNode=cfg["min_leaf"],
                                      seed=SEED, **w)
    if k == "forest":
        return RandomForestClassifier(featuresCol=features_col, labelCol=label,
                                      numTrees=cfg["n_trees"], maxDepth=cfg["max_depth"],
                                      minInstancesPerNode=cfg["min_leaf"], seed=SEED,
                                      cacheNodeIds=True, maxMemoryInMB=PASS_MB, **w)
    if k == "gbt":
        return GBTClassifier(featuresCol=features_col, labelCol=label, maxIter=cfg["n_iter"],
                             maxDepth=cfg["max_depth"], stepSize=cfg["step"],
                             subsamplingRate=cfg["subsample"],
                             featureSubsetStrategy=("all" if cfg["colsample"] >= 1.0
                                                    else str(cfg["colsample"])), seed=SEED, **w)
    raise ValueError(f"unknown model kind {k}")


def weighted(df: DataFrame, scheme: str | None, label: str = LABEL, col: str = "weight"):
    """B2/B3 weights as a column: 'balanced' n/(k*n_c), 'positive' n0/n1 on
    the positive class.  Returns (frame, weight column or None, sum of weights)."""
    if scheme is None:
        return df, None, float(df.count())
    if scheme == "balanced":
        w = with_class_weight(df, label, col)
        return w, col, float(w.agg(F.sum(col)).first()[0])
    if scheme == "positive":
        row = df.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n0"),
                     F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1")).first()
        pw = (row["n0"] / row["n1"]) if row["n1"] else 1.0
        w = df.withColumn(col, F.when(F.col(label) == 1, F.lit(float(pw))).otherwise(F.lit(1.0)))
        return w, col, float(row["n0"] + pw * row["n1"])
    raise ValueError(scheme)


def train(train_df: DataFrame, features: Sequence[str], preset: str = "logistic",
          label: str = LABEL, name: str | None = None, **overrides) -> TrainedModel:
    """Fit one classifier of a preset (M1-M5, M7) on a prepared frame."""
    cfg = {**PRESETS[preset], **overrides}
    features = list(features)
    scaler = ScalerModel.fit(train_df, features) if cfg.get("scaled") else None
    tm = TrainedModel(name or preset.replace("_fast", ""), None, features, scaler, cfg)
    x, wcol, sw = weighted(tm.inputs(train_df), cfg.get("weights"), label)
    inputs = [f"_s_{c}" for c in features] if scaler else features
    asm = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
    est = _estimator(cfg, "features", label, wcol, len(features), sw)
    tm.model = Pipeline(stages=[asm, est]).fit(x)
    return tm


def feature_list(df: DataFrame, exclude=(KEY, LABEL, "split")) -> list[str]:
    from riskspark.operators.prep import numeric_columns
    return numeric_columns(df, exclude=exclude)


def score_all(models: Sequence[TrainedModel], df: DataFrame, key: str = KEY,
              label: str = LABEL) -> DataFrame:
    """Scores of several models side by side, aligned by key: (key, label,
    p_<m>, pred_<m>...).  Each model adds a projection over the same rows
    (one scan), never a join of separately scored frames."""
    out = df
    for m in models:
        out = m.score(out)
    return out.select(key, label, *[c for m in models for c in (f"p_{m.name}", f"pred_{m.name}")])


def long_scores(scored: DataFrame, models: Sequence[str], label: str = LABEL) -> DataFrame:
    """Unpivot ``p_<m>`` columns into (model, label, score) for grouped evaluation."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("score")) for m in models])
    return scored.select(label, F.explode(arr).alias("_m")).select("_m.model", label, "_m.score")
