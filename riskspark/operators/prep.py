"""Fitted preparation: clean + derive (Q9, F1-F19) and impute/encode/cap/scale
(P1-P6).

The reference decides its schema from the data (columns above 40 % nulls
vanish, derived columns follow their inputs).  Here that decision is one
aggregate action at ``fit`` time; ``transform`` is then a pure projection
that Catalyst compiles into the scan's codegen stage, with one equi-join per
categorical column to its table of codes.  Only fitted statistics (a few
numbers per column) ever reach the driver; codes stay a table whatever their
number.  A fitted ``Preparation`` is saved and loaded as Parquet tables.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.features import derive_features
from riskspark.operators.ordered import quantile_map
from riskspark.session import stored

# Fixed values of the preparation rules.
KEY = "SK_ID_CURR"
LABEL = "TARGET"
NULL_LIMIT = 0.40                       # drop a column when its null rate is > 0.40
MISSING_CATEGORY = "MISSING"
CAP_COLUMNS = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CREDIT_INCOME_RATIO")
IQR_K = 1.5
INCOME_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame, exclude=(KEY, LABEL)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=(KEY, LABEL)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def null_rates(df: DataFrame) -> dict[str, float]:
    """Null rate of every column in one aggregate (Q6/Q9 fit statistic)."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in df.columns}


@dataclass
class FeatureModel:
    """Q9 + F1-F18: kept columns and fitted income quartile edges."""
    kept: list[str]
    dropped: list[str]
    income_quartiles: list[float] | None

    @classmethod
    def fit(cls, df: DataFrame, null_limit: float = NULL_LIMIT,
            approx: bool = False) -> "FeatureModel":
        rates = null_rates(df)
        kept = [c for c in df.columns if not rates[c] > null_limit]
        dropped = [c for c in df.columns if rates[c] > null_limit]
        q = None
        if "AMT_INCOME_TOTAL" in kept:
            q = quantile_map(df, ["AMT_INCOME_TOTAL"], INCOME_PROBS, approx)["AMT_INCOME_TOTAL"]
            if any(v is None for v in q):
                q = None
        return cls(kept, dropped, q)

    @classmethod
    def fit_persisted(cls, df: DataFrame, **kw) -> "FeatureModel":
        """``fit`` with the input kept in executor memory/disk for its passes."""
        p = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return cls.fit(p, **kw)
        finally:
            p.unpersist()

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """``keep``: extra columns carried through unchanged (after the
        derived ones).  A kept column that a later batch lacks is left out,
        and so are the features derived from it."""
        return derive_features(df.select(*[c for c in self.kept if c in df.columns], *keep), self.income_quartiles)


def clean_and_derive(df: DataFrame, approx: bool = False) -> DataFrame:
    """``preprocess_data``: fit on ``df`` and apply to it (fit_on='all')."""
    return FeatureModel.fit_persisted(df, approx=approx).transform(df)


@dataclass
class PrepModel:
    """Median imputation, category codes, IQR caps, column alignment."""
    numeric: list[str]
    medians: dict[str, float | None]
    categorical: list[str]
    codes: DataFrame | None            # (name, value, code); None without categories
    caps: dict[str, tuple[float, float]]
    columns: list[str] = field(default_factory=list)   # output order (P4)

    @classmethod
    def fit(cls, df: DataFrame, approx: bool = False,
            cap_columns=CAP_COLUMNS, k: float = IQR_K) -> "PrepModel":
        num = numeric_columns(df)
        cat = string_columns(df)
        # every fit pass reads only these columns: keep them for the fit
        src = df.select(*num, *cat).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            med = {c: v[0] for c, v in quantile_map(src, num, [0.5], approx, persist=False).items()}
            codes = fit_category_codes(src, cat)
            caps_in = [c for c in cap_columns if c in num]
            imputed = src.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c)
                                   for c in caps_in])
            qs = quantile_map(imputed, caps_in, [0.25, 0.75], approx, persist=False)
        finally:
            src.unpersist()
        caps = {}
        for c in caps_in:
            q1, q3 = qs[c]
            if q1 is not None:
                iqr = q3 - q1
                caps[c] = (q1 - k * iqr, q3 + k * iqr)
        cols = [c for c in df.columns if c in num or c in cat or c in (KEY, LABEL)]
        return cls(num, med, cat, codes, caps, cols)

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """Imputed numerics become double (as the reference's imputer returns
        floats); categories become integer codes; unseen categories -> -1.
        Columns the model was fitted on but the frame lacks are added as 0 and
        extra columns are dropped (P4)."""
        have = set(df.columns)
        out = []
        for i, c in enumerate(self.columns):
            if c not in have:
                out.append(F.lit(0.0).alias(c))
            elif c in self.numeric:
                x = F.col(c).cast("double")
                m = self.medians.get(c)
                if m is not None:
                    x = F.coalesce(x, F.lit(float(m)))
                if c in self.caps:
                    lo, hi = self.caps[c]
                    x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
                out.append(x.alias(c))
            elif c in self.categorical:
                # a small table is broadcast by its measured size, a large one meets the rows by a shuffle on the value
                own = self.codes.where(F.col("name") == c).select(F.col("value").alias(f"_value_{i}"), F.col("code").alias(f"_code_{i}"))
                df = df.join(own, category(F.col(c)) == F.col(f"_value_{i}"), "left")
                out.append(F.coalesce(f"_code_{i}", F.lit(-1)).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out, *keep)

    @property
    def feature_columns(self) -> list[str]:
        return [c for c in self.columns if c not in (KEY, LABEL)]


def category(c):
    """A category as it is coded: nulls are a category of their own."""
    return F.coalesce(c, F.lit(MISSING_CATEGORY))


def fit_category_codes(df: DataFrame, cat_cols: list[str]) -> DataFrame | None:
    """(name, value, code): code = position in the column's sorted distinct values.

    The distinct values are sorted over the cluster by range; a value's code is
    its place in its task's part plus the number of the column's values in the
    parts before, so neither a task nor the driver holds a whole column.
    """
    if not cat_cols:
        return None
    values = (df.select(*[category(F.col(c)).alias(c) for c in cat_cols]).withColumn("_g", F.lit(0))
              .unpivot(["_g"], cat_cols, "name", "value").select("name", "value").distinct())
    placed = stored(values.repartitionByRange("name", "value").sortWithinPartitions("name", "value")
                    .withColumn("at", F.monotonically_increasing_id()), "category-values")
    placed = placed.withColumn("part", F.shiftright("at", 33))          # the task that numbered the row
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy("name", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
             .select("name", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    return stored(placed.join(parts, ["name", "part"]).select(
        "name", "value", (F.col("at") - F.col("first") + F.col("before")).cast("int").alias("code")), "category-codes")


@dataclass
class Preparation:
    """A fitted preparation as a whole: raw rows -> model-ready rows."""
    features: FeatureModel
    prep: PrepModel

    @classmethod
    def fit(cls, df: DataFrame, approx: bool = False) -> "Preparation":
        fm = FeatureModel.fit_persisted(df, approx=approx)
        return cls(fm, PrepModel.fit(fm.transform(df), approx=approx))

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        return self.prep.transform(self.features.transform(df, keep), keep)

    def save(self, path: str) -> None:
        """Tables ``raw``, ``quartiles``, ``columns`` and ``codes`` under ``path``."""
        fm, pm = self.features, self.prep
        spark = SparkSession.getActiveSession()

        def write(name: str, rows: list, schema: str) -> None:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, name))

        write("raw", [(i, c, c in fm.kept) for i, c in enumerate([*fm.kept, *fm.dropped])], "place int, name string, kept boolean")
        write("quartiles", list(enumerate(fm.income_quartiles or [])), "place int, value double")
        kind = lambda c: "numeric" if c in pm.numeric else "categorical" if c in pm.categorical else "other"
        write("columns", [(i, c, kind(c), pm.medians.get(c), *pm.caps.get(c, (None, None))) for i, c in enumerate(pm.columns)],
              "place int, name string, kind string, median double, cap_low double, cap_high double")
        if pm.codes is not None:
            pm.codes.write.mode("overwrite").parquet(os.path.join(path, "codes"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preparation":
        """A preparation saved before, perhaps by another session; a few rows per column are read."""
        read = lambda name: spark.read.parquet(os.path.join(path, name))
        raw, cols = read("raw").orderBy("place").collect(), read("columns").orderBy("place").collect()
        quartiles = [r["value"] for r in read("quartiles").orderBy("place").collect()]
        of = lambda kind: [r["name"] for r in cols if r["kind"] == kind]
        fm = FeatureModel([r["name"] for r in raw if r["kept"]], [r["name"] for r in raw if not r["kept"]], quartiles or None)
        return cls(fm, PrepModel(of("numeric"), {c["name"]: c["median"] for c in cols if c["kind"] == "numeric"}, of("categorical"),
                                 read("codes") if of("categorical") else None,
                                 {c["name"]: (c["cap_low"], c["cap_high"]) for c in cols if c["cap_low"] is not None},
                                 [c["name"] for c in cols]))


@dataclass
class ScalerModel:
    """Standard scaling with population std; constant columns divide by 1."""
    means: dict[str, float]
    stds: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> "ScalerModel":
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        means = {c: float(row[f"m_{c}"] or 0.0) for c in cols}
        stds = {c: (float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0) for c in cols}
        return cls(means, stds)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.stds[c])
                               for c in self.means})


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """P6 on a frame: fit the scaler (one aggregate, two numbers per column)
    and apply it as a projection."""
    return ScalerModel.fit(df, cols).transform(df)
