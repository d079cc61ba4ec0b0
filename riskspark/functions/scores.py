"""Deterministic scores, risk bands and record rules as column expressions.

The deterministic scores stand in for trained models where an operator is
checked against SQL (evaluation, ensembles, bands): fixed formulas that both
Spark and the oracle compute with the same IEEE operations, rounded to four
digits (``floor(x * 10000 + 0.5) / 10000``) so that ties occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Risk band cut points of the reference.
BATCH_BANDS = ((0.7, "High"), (0.3, "Medium"))       # > .7 High, > .3 Medium, else Low
API_BANDS = ((0.3, "Low"), (0.7, "Medium"))          # < .3 Low, < .7 Medium, else High
TWO_LEVEL_CUT = 0.5                                  # > .5 High Risk, else Low Risk
EXT_DEFAULT = 0.5                                    # missing/zero ext score in the API


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def credit_income_capped(df_cols=None) -> Column:
    cir = F.try_divide(F.col("AMT_CREDIT"), F.when(F.col("AMT_INCOME_TOTAL") != 0,
                                                   F.col("AMT_INCOME_TOTAL")))
    return F.when(cir.isNull() | (cir > 10), F.lit(10.0)).otherwise(cir)


def deterministic_scores(apps: DataFrame) -> DataFrame:
    """(SK_ID_CURR, TARGET, p_logistic, p_tree, p_forest) from the applicant
    columns; three fixed "models" with different shapes (smooth, step, smooth)."""
    cap = credit_income_capped()
    e2 = F.coalesce(F.col("EXT_SOURCE_2"), F.lit(0.5))
    e3 = F.coalesce(F.col("EXT_SOURCE_3"), F.lit(0.5))
    p_log = round4(_sigmoid(cap * 0.8 / 10 - e2 * 1.5))
    p_tree = (F.when(F.col("AMT_INCOME_TOTAL") < 20000, F.lit(0.45))
              .when(e3 < 0.3, F.lit(0.25))
              .when(F.col("CNT_CHILDREN") >= 3, F.lit(0.15))
              .otherwise(F.lit(0.05)))
    p_for = round4(_sigmoid(cap * 0.3 / 10 + (F.lit(0.6) - e3) * 0.9 - 1.2))
    return apps.select("SK_ID_CURR", "TARGET", p_log.alias("p_logistic"),
                       p_tree.alias("p_tree"), p_for.alias("p_forest"))


SCORES_SQL = """
SELECT SK_ID_CURR, TARGET,
  floor(1 / (1 + exp(-(cap * 0.8e0 / 10 - coalesce(EXT_SOURCE_2, 0.5e0) * 1.5e0))) * 10000 + 0.5e0) / 10000 AS p_logistic,
  CASE WHEN AMT_INCOME_TOTAL < 20000 THEN 0.45e0
       WHEN coalesce(EXT_SOURCE_3, 0.5e0) < 0.3e0 THEN 0.25e0
       WHEN CNT_CHILDREN >= 3 THEN 0.15e0 ELSE 0.05e0 END AS p_tree,
  floor(1 / (1 + exp(-(cap * 0.3e0 / 10 + (0.6e0 - coalesce(EXT_SOURCE_3, 0.5e0)) * 0.9e0 - 1.2e0))) * 10000 + 0.5e0) / 10000 AS p_forest
FROM (SELECT *, CASE WHEN AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) IS NULL
                       OR AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) > 10 THEN 10e0
                     ELSE AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) END AS cap
      FROM applications) a
"""


def band_batch(p: Column) -> Column:
    """R2: > .7 High, > .3 Medium, else Low."""
    (hi, hn), (mi, mn) = BATCH_BANDS
    return F.when(p > hi, hn).when(p > mi, mn).otherwise("Low")


def band_api(p: Column) -> Column:
    """< .3 Low, < .7 Medium, else High."""
    (lo, ln), (mi, mn) = API_BANDS
    return F.when(p < lo, ln).when(p < mi, mn).otherwise("High")


def band_two_level(p: Column) -> Column:
    """> .5 High Risk, else Low Risk."""
    return F.when(p > TWO_LEVEL_CUT, "High Risk").otherwise("Low Risk")


BANDS = {"batch": band_batch, "api": band_api, "two_level": band_two_level}


# --- record rules (Q3) -------------------------------------------------------
# Field rules of a scoring request (name, check); the request
# fields are income, credit, annuity, children, ext_source_2/3, age and years
# employed.
def record_rules() -> list[tuple[str, Column]]:
    c = F.col
    def rng(x, lo, hi):
        return (x >= lo) & (x <= hi)
    return [
        ("amt_income_total", c("amt_income_total").isNotNull() & (c("amt_income_total") > 0)),
        ("amt_credit", c("amt_credit").isNotNull() & (c("amt_credit") > 0)),
        ("amt_annuity", c("amt_annuity").isNotNull() & (c("amt_annuity") >= 0)),
        ("cnt_children", rng(F.coalesce(c("cnt_children"), F.lit(0)), 0, 20)),
        ("ext_source_2", c("ext_source_2").isNull() | rng(c("ext_source_2"), 0, 1)),
        ("ext_source_3", c("ext_source_3").isNull() | rng(c("ext_source_3"), 0, 1)),
        ("age", c("age").isNotNull() & rng(c("age"), 18, 100)),
        ("employ_years", rng(F.coalesce(c("employ_years"), F.lit(0.0)), 0, 50)),
    ]


def request_fields(apps: DataFrame, keep=()) -> DataFrame:
    """The eight request fields of a scoring call, derived from applicant rows
    (age and years employed from day counts; the 365243 sentinel is unknown)."""
    emp = F.when(F.col("DAYS_EMPLOYED") != 365243, -(F.col("DAYS_EMPLOYED") / 365.0))
    return apps.select(
        "SK_ID_CURR",
        F.col("AMT_INCOME_TOTAL").alias("amt_income_total"),
        F.col("AMT_CREDIT").alias("amt_credit"),
        F.col("AMT_ANNUITY").alias("amt_annuity"),
        F.col("CNT_CHILDREN").alias("cnt_children"),
        F.col("EXT_SOURCE_2").alias("ext_source_2"),
        F.col("EXT_SOURCE_3").alias("ext_source_3"),
        (-F.col("DAYS_BIRTH") / 365.0).alias("age"),
        emp.alias("employ_years"), *keep)


def api_feature_vector(req: DataFrame, keep=()) -> DataFrame:
    """The fixed-order 8 model inputs of the API: ext scores that are null
    or zero become 0.5 (``x or 0.5``), children/years default to 0."""
    ext = lambda x: F.coalesce(F.when(F.col(x) != 0, F.col(x)), F.lit(EXT_DEFAULT))
    return req.select(
        "SK_ID_CURR",
        F.col("amt_income_total").cast("double").alias("AMT_INCOME_TOTAL"),
        F.col("amt_credit").cast("double").alias("AMT_CREDIT"),
        F.col("amt_annuity").cast("double").alias("AMT_ANNUITY"),
        F.coalesce(F.col("cnt_children"), F.lit(0)).cast("double").alias("CNT_CHILDREN"),
        ext("ext_source_2").cast("double").alias("EXT_SOURCE_2"),
        ext("ext_source_3").cast("double").alias("EXT_SOURCE_3"),
        F.col("age").cast("double").alias("AGE"),
        F.coalesce(F.col("employ_years"), F.lit(0.0)).cast("double").alias("EMPLOY_YEARS"), *keep)
