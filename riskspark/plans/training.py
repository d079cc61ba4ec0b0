"""Train-and-compare workflow (the reference's training page) as Spark jobs.

applications -> clean/derive (fit) -> impute/encode/cap (fit) -> stratified
split (fit) -> weights -> Spark ML fits -> scores of the test part aligned by
key -> one grouped evaluation.

Preparation is fitted on the training part (D2); ``fit_on="all"`` fits it on
all rows, the reference's order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import evaluate as E
from riskspark.operators.models import TrainedModel, feature_list, long_scores, score_all, train
from riskspark.operators.prep import FeatureModel, PrepModel
from riskspark.operators.sampling import SplitModel
from riskspark.session import checkpoint_dir, stored
from riskspark.sources.tables import applications


@dataclass
class Workbench:
    prepared: DataFrame
    train: DataFrame
    test: DataFrame
    features: list[str]
    feature_model: FeatureModel
    prep_model: PrepModel
    split: SplitModel
    applications: DataFrame

    def release(self):
        self.train.unpersist()
        self.test.unpersist()


def workbench(spark: SparkSession, sf_dir: str, fit_on: str = "train",
              persist: bool = True) -> Workbench:
    # tree ensembles cut their lineage every few iterations into the
    # session's shared checkpoint folder (set here only when the session has none)
    checkpoint_dir(spark)
    # joined once and written: every fit and both parts read these files, in
    # tasks cut by size, whatever the number of shuffle partitions.  Iterations
    # then run a task per core or per file split, not hundreds of tiny ones
    apps = stored(applications(spark, sf_dir), "applications")
    split = SplitModel.fit(apps)
    fit_src = apps if fit_on == "all" else split.train(apps)
    fm = FeatureModel.fit(fit_src)
    feats_fit = fm.transform(fit_src)
    pm = PrepModel.fit(feats_fit)
    prepared = pm.transform(fm.transform(apps))
    train_df, test_df = split.train(prepared), split.test(prepared)
    if persist:
        # the training part is read once per optimizer iteration: keep it in
        # executor memory (spills to disk; lost blocks recompute from the scan)
        train_df = train_df.persist(StorageLevel.MEMORY_AND_DISK)
        test_df = test_df.persist(StorageLevel.MEMORY_AND_DISK)
    return Workbench(prepared, train_df, test_df, feature_list(prepared), fm, pm, split, apps)


def train_models(wb: Workbench, presets=("logistic", "tree")) -> list[TrainedModel]:
    return [train(wb.train, wb.features, p) for p in presets]


def compare(models: list[TrainedModel], test: DataFrame) -> DataFrame:
    """E6 + E11 for trained models: metrics per model with its best-profit
    threshold, from one scored frame of the test part."""
    sc = score_all(models, test)
    long = long_scores(sc, [m.name for m in models])
    cmp_ = E.model_comparison(long)
    best = E.best_row(E.profit_curve(long, "TARGET", "score", by=["model"]), "profit", by=["model"])
    return cmp_.join(best.select("model", F.col("threshold").alias("best_threshold"),
                                 F.col("profit").alias("best_profit")), "model")
