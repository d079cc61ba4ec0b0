"""Model explanation.

* Linear SHAP with independent features has the closed form
  ``phi_j = beta_j * (x_j - E_background[x_j])``: a projection plus one
  aggregate for the background means, no sampling of coalitions.
* Coefficients and importances are model parameters (one value per feature)
  turned into small DataFrames.
* Partial dependence expands each row by the fixed-size grid (explode of a
  literal array), scores the expanded rows with the model on the executors and
  averages per grid point.  A logistic model's margin is a sum, so the part of
  the other features is added up once per row and only that number is expanded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sizes used by the reference's explanation pages.
PDP_POINTS = 50
TOP_COEFFICIENTS = 10
TOP_IMPORTANCES = 15


def linear_shap(explained: DataFrame, background: DataFrame, coefs: dict[str, float],
                key: str = "SK_ID_CURR") -> DataFrame:
    """Per-row SHAP values of a linear model: (key, <feature>...).
    The background means are fitted statistics used as literals."""
    m = background.agg(*[F.avg(c).alias(c) for c in coefs]).first()     # one mean per feature
    return explained.select(key, *[(F.lit(float(b)) * (F.col(c) - F.lit(m[c]))).alias(c)
                                   for c, b in coefs.items()])


def linear_shap_summary(explained: DataFrame, background: DataFrame,
                        coefs: dict[str, float], key: str = "SK_ID_CURR") -> DataFrame:
    """X10 summary: mean |SHAP| per feature, long form (feature, mean_abs_shap)."""
    sv = linear_shap(explained, background, coefs, key)
    row = sv.agg(*[F.avg(F.abs(c)).alias(c) for c in coefs])
    return row.unpivot([], list(coefs), "feature", "mean_abs_shap")


def attribution(rows: DataFrame, background: DataFrame, coefs: dict[str, float], intercept: float = 0.0,
                key: str = "SK_ID_CURR") -> DataFrame:
    """X10 breakdown of every row: (key, base, logit, parts), where parts is an
    array of (feature, value, part), largest effect first, and base plus
    all parts is the logit.  ``base`` is the logit of the background's means."""
    m = background.agg(*[F.avg(c).alias(c) for c in coefs]).first()     # one mean per feature
    base = intercept + sum(float(b) * m[c] for c, b in coefs.items())
    part = lambda c: F.lit(float(coefs[c])) * (F.col(c) - F.lit(m[c]))
    logit = sum((F.lit(float(b)) * F.col(c) for c, b in coefs.items()), F.lit(float(intercept)))
    parts = F.array(*[F.struct((-F.abs(part(c))).alias("order"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), part(c).alias("part"))
                      for c in coefs])
    shown = F.transform(F.array_sort(parts), lambda p: F.struct(p["feature"].alias("feature"), p["value"].alias("value"), p["part"].alias("part")))
    return rows.select(key, F.lit(base).alias("base"), logit.alias("logit"), shown.alias("parts"))


def breakdown(attributed: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """``attribution`` as a table: (key, base, logit, rank, feature, value, part)."""
    return attributed.select(key, "base", "logit", F.posexplode("parts").alias("rank", "p")).select(
        key, "base", "logit", (F.col("rank") + 1).alias("rank"), "p.*")


def coefficient_table(spark: SparkSession, names: Sequence[str], coefs: Sequence[float]) -> DataFrame:
    """(feature, coefficient, abs_coefficient) of a linear model."""
    rows = [(n, float(c)) for n, c in zip(names, coefs)]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.withColumn("abs_coefficient", F.abs("coefficient"))


def top_coefficients(table: DataFrame, n: int = TOP_COEFFICIENTS) -> tuple[DataFrame, DataFrame]:
    """The n largest and n smallest coefficients (signed)."""
    return (table.orderBy(F.col("coefficient").desc(), "feature").limit(n),
            table.orderBy(F.col("coefficient").asc(), "feature").limit(n))


def importance_table(spark: SparkSession, names: Sequence[str], importances) -> DataFrame:
    """(feature, importance) from a tree model's ``featureImportances``
    paired with the assembler's input columns (D13)."""
    vals = importances.toArray() if hasattr(importances, "toArray") else list(importances)
    rows = [(n, float(v)) for n, v in zip(names, vals)]
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.col("importance").desc(), "feature"))


def partial_dependence(model, df: DataFrame, feature: str, points: int = PDP_POINTS) -> DataFrame:
    """X11: mean predicted probability over a linear grid of ``points`` values
    between the feature's min and max, on all rows:
    (grid_value, mean_probability).  ``model`` is a ``TrainedModel`` scoring
    prepared rows; every row is expanded by the fixed-size grid and averaged
    before the shuffle.  With a logistic model only a row's margin is."""
    mm = df.agg(F.min(feature).alias("mn"), F.max(feature).alias("mx")).first()
    mn, mx = float(mm["mn"]), float(mm["mx"])
    step = (mx - mn) / (points - 1) if points > 1 else 0.0
    grid = F.array(*[F.lit(mn + i * step) for i in range(points)])
    if _is_logistic(model):
        scored = _swept_logistic(model, df, feature, grid)
    else:
        expanded = df.withColumn("grid_value", F.explode(grid)).withColumn(
            feature, F.col("grid_value"))
        scored = model.score(expanded)
    return (scored.groupBy("grid_value").agg(F.avg(f"p_{model.name}").alias("mean_probability"))
            .orderBy("grid_value"))


def _is_logistic(model) -> bool:
    """A binomial logistic model: one row of coefficients."""
    c = model.classifier
    return isinstance(c, LogisticRegressionModel) and c.coefficientMatrix.numRows == 1


def _swept_logistic(model, df: DataFrame, feature: str, grid) -> DataFrame:
    """(grid_value, p_<model>) of every row at every grid value.  Null and NaN
    inputs are an error, as they are to the model's assembler."""
    c = model.classifier
    coefs = {f: float(b) for f, b in zip(model.features, c.coefficients.toArray())}
    scaled = lambda f, x: ((x - F.lit(model.scaler.means[f])) / F.lit(model.scaler.stds[f])
                           if model.scaler else x)
    own = coefs.pop(feature, None)
    rest, usable = F.lit(float(c.intercept)), F.lit(True)
    for f, b in coefs.items():
        x = F.col(f).cast("double")
        rest, usable = rest + F.lit(b) * scaled(f, x), usable & x.isNotNull() & ~F.isnan(x)
    rest = F.when(usable, rest).otherwise(F.raise_error(F.lit(f"null or NaN among the inputs of {model.name}")))
    swept = df.select(rest.alias("_rest")).withColumn("grid_value", F.explode(grid))
    margin = F.col("_rest")
    if own is not None:
        margin = margin + F.lit(own) * scaled(feature, F.col("grid_value"))
    return swept.select("grid_value", (1 - 1 / (1 + F.exp(margin))).alias(f"p_{model.name}"))
