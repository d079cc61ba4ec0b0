"""Batch and what-if scoring.

R1 is one job: raw rows -> fitted clean/derive -> fitted impute/encode/cap
-> model probability -> 0/1 -> risk band, appended to the input rows.  The
preparation models are fitted on training data and applied (D1);
``refit=True`` refits them on the batch as the reference does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.scores import BANDS
from riskspark.operators.models import TrainedModel
from riskspark.operators.prep import KEY, FeatureModel, PrepModel


def batch_score(raw: DataFrame, fm: FeatureModel, pm: PrepModel, model: TrainedModel,
                bands: str = "batch", threshold: float = 0.5, refit: bool = False,
                key: str = KEY) -> DataFrame:
    """Input rows + ``probability``, ``prediction``, ``risk_band``."""
    if refit:
        fm = FeatureModel.fit(raw)
        pm = PrepModel.fit(fm.transform(raw))
    # the input columns ride along under a prefix: one pass, no join back
    carried = [f"_in_{c}" for c in raw.columns]
    x = raw.select(*raw.columns, *[F.col(c).alias(f"_in_{c}") for c in raw.columns])
    prepared = pm.transform(fm.transform(x, keep=carried), keep=carried)
    # The model sees exactly its training columns (missing -> 0)
    have = set(prepared.columns)
    prepared = prepared.select(*[F.col(c) if c in have else F.lit(0.0).alias(c)
                                 for c in model.features], *carried)
    sc = model.score(prepared, threshold)
    p = F.col(f"p_{model.name}")
    return sc.select(*[F.col(f"_in_{c}").alias(c) for c in raw.columns],
                     p.alias("probability"), F.col(f"pred_{model.name}").alias("prediction"),
                     BANDS[bands](p).alias("risk_band"))


def band_counts(scored: DataFrame, band_col: str = "risk_band") -> DataFrame:
    """(band, n, total)."""
    g = scored.groupBy(band_col).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy()))


# The fields a what-if scenario may override (API field names
# mapped onto applicant columns; age and years employed become day counts).
WHAT_IF_FIELDS = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CNT_CHILDREN",
                  "EXT_SOURCE_2", "EXT_SOURCE_3", "AGE", "EMPLOY_YEARS")


def what_if(base: DataFrame, scenarios: Sequence[dict], fm: FeatureModel, pm: PrepModel,
            model: TrainedModel, key: str = KEY) -> DataFrame:
    """Every base row under every scenario (a fixed, small list of field
    overrides): overrides applied to the raw fields, ratios and all derived
    features recomputed by the fitted feature model, then scored.  Output:
    (key, scenario, probability, risk_band)."""
    fields = [f for f in WHAT_IF_FIELDS]
    structs = []
    for i, sc in enumerate(scenarios):
        structs.append(F.struct(F.lit(i).alias("scenario"),
                                *[F.lit(sc.get(f)).cast("double").alias(f) for f in fields]))
    x = base.withColumn("_s", F.explode(F.array(*structs)))
    ov = lambda f: F.col(f"_s.{f}")
    x = x.withColumns({
        "AMT_INCOME_TOTAL": F.coalesce(ov("AMT_INCOME_TOTAL"), F.col("AMT_INCOME_TOTAL")),
        "AMT_CREDIT": F.coalesce(ov("AMT_CREDIT"), F.col("AMT_CREDIT")),
        "AMT_ANNUITY": F.coalesce(ov("AMT_ANNUITY"), F.col("AMT_ANNUITY")),
        "CNT_CHILDREN": F.coalesce(ov("CNT_CHILDREN").cast("bigint"), F.col("CNT_CHILDREN")),
        "EXT_SOURCE_2": F.coalesce(ov("EXT_SOURCE_2"), F.col("EXT_SOURCE_2")),
        "EXT_SOURCE_3": F.coalesce(ov("EXT_SOURCE_3"), F.col("EXT_SOURCE_3")),
        "DAYS_BIRTH": F.coalesce((-ov("AGE") * 365).cast("bigint"), F.col("DAYS_BIRTH")),
        "DAYS_EMPLOYED": F.coalesce((-ov("EMPLOY_YEARS") * 365).cast("bigint"), F.col("DAYS_EMPLOYED")),
        "_scenario": F.col("_s.scenario"),
    }).drop("_s")
    prepared = pm.transform(fm.transform(x, keep=["_scenario"]), keep=["_scenario"])
    sc = model.score(prepared)
    p = F.col(f"p_{model.name}")
    return sc.select(key, F.col("_scenario").alias("scenario"), p.alias("probability"),
                     BANDS["two_level"](p).alias("risk_band"))
