"""Aggregations and profiling.

Default rate is ``avg(TARGET)``.  Several dimensions are profiled in one scan:
the dimensions are unpivoted into (dimension, value) pairs and grouped once,
so the partial aggregation runs before a single shuffle, and a value held by
a third of all rows is combined map-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.features import age_group
from riskspark.functions.keys import hash_key
from riskspark.operators.ordered import exact_quantiles
from riskspark.operators.prep import KEY, LABEL

# Group-size minimums and chart sizes of the reference.
MIN_GROUP_INCOME_TYPE = 100
MIN_GROUP_ORGANIZATION = 500
TOP_ORGANIZATIONS = 15
MAX_FAMILY_SIZE = 6
TOP_CORRELATIONS = 15
SCATTER_ROWS = 5000
WHISKER_K = 1.5
KEY_FEATURES = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CNT_CHILDREN",
                "EXT_SOURCE_2", "EXT_SOURCE_3", "AGE", "EMPLOY_YEARS")
DESCRIBE_COLUMNS = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CNT_CHILDREN")
RATE_DIMENSIONS = ("NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "CNT_CHILDREN",
                   "WEEKDAY_APPR_PROCESS_START", "HOUR_APPR_PROCESS_START", "REGION_RATING_CLIENT")


def overview(df: DataFrame, label: str = LABEL) -> DataFrame:
    """A1: rows, columns, defaults, default and non-default rate (%)."""
    rate = F.avg(F.col(label).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                  F.sum(F.col(label)).cast("bigint").alias("n_default"),
                  (rate * 100).alias("default_rate_pct"),
                  ((1 - rate) * 100).alias("non_default_rate_pct"))


def label_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """A2: (label, n, share).  Share uses a window over the (two-row) grouped
    result, not over rows."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.select(label, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def default_rate_by(df: DataFrame, dim: str, label: str = LABEL, min_count: int = 0,
                    top: int | None = None) -> DataFrame:
    """(dim, default_rate, n), groups with n >= min_count,
    highest rate first (ties by value), optionally top-k."""
    g = (df.groupBy(dim).agg(F.avg(F.col(label).cast("double")).alias("default_rate"),
                             F.count(F.lit(1)).alias("n"))
         .where(F.col("n") >= min_count))
    g = g.orderBy(F.col("default_rate").desc(), F.col(dim).asc_nulls_first())
    return g.limit(top) if top else g


def default_rate_by_many(df: DataFrame, dims: Sequence[str], label: str = LABEL) -> DataFrame:
    """Default rate by several dimensions in one scan and one shuffle:
    (dimension, value, default_rate, n).  Values are strings."""
    dims = [d for d in dims if d in df.columns]
    long = (df.select(F.col(label).cast("double").alias("_y"),
                      *[F.col(d).cast("string").alias(d) for d in dims])
            .unpivot(["_y"], dims, "dimension", "value"))
    return long.groupBy("dimension", "value").agg(F.avg("_y").alias("default_rate"),
                                                  F.count(F.lit(1)).alias("n"))


def default_rate_by_family_size(df: DataFrame, label: str = LABEL,
                                max_size: int = MAX_FAMILY_SIZE) -> DataFrame:
    """By CNT_FAM_MEMBERS, sizes <= 6 (filter pushed below the aggregate)."""
    return (df.where(F.col("CNT_FAM_MEMBERS") <= max_size)
            .groupBy("CNT_FAM_MEMBERS").agg(F.avg(F.col(label).cast("double")).alias("default_rate"),
                                            F.count(F.lit(1)).alias("n")))


def default_rate_by_age_group(df: DataFrame, label: str = LABEL) -> DataFrame:
    """By the F19 age group label."""
    return (df.withColumn("AGE_GROUP", age_group(F.col("AGE")))
            .groupBy("AGE_GROUP").agg(F.avg(F.col(label).cast("double")).alias("default_rate"),
                                      F.count(F.lit(1)).alias("n")))


def crosstab_pct(df: DataFrame, dim: str, label: str = LABEL) -> DataFrame:
    """Row-normalised cross tab x100: (dim, pct_0, pct_1)."""
    y = F.col(label)
    return df.groupBy(dim).agg(
        (F.avg(F.when(y == 0, 1.0).otherwise(0.0)) * 100).alias("pct_0"),
        (F.avg(F.when(y == 1, 1.0).otherwise(0.0)) * 100).alias("pct_1"))


def label_means(df: DataFrame, cols: Sequence[str], label: str = LABEL) -> DataFrame:
    """A10: mean of each column by label, long form (column, label, mean)."""
    cols = [c for c in cols if c in df.columns]
    g = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])
    return g.unpivot([label], cols, "column", "mean").select("column", label, "mean")


def insights(df: DataFrame, label: str = LABEL,
             cols=("EXT_SOURCE_2", "AMT_INCOME_TOTAL", "AGE")) -> DataFrame:
    """Default rate plus label gaps (mean_default - mean_non_default),
    only for columns present and only when both labels occur."""
    cols = [c for c in cols if c in df.columns]
    y = F.col(label)
    aggs = [(F.avg(y.cast("double")) * 100).alias("rate"),
            F.countDistinct(y).alias("_k")]
    for c in cols:
        aggs += [F.avg(F.when(y == 0, F.col(c))).alias(f"{c}__0"),
                 F.avg(F.when(y == 1, F.col(c))).alias(f"{c}__1")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit("default_rate_pct").alias("insight"),
                      F.lit(None).cast("double").alias("non_default"),
                      F.col("rate").alias("default"),
                      F.lit(None).cast("double").alias("gap"))]
    parts += [F.struct(F.lit(c).alias("insight"), F.col(f"{c}__0").alias("non_default"),
                       F.col(f"{c}__1").alias("default"),
                       (F.col(f"{c}__1") - F.col(f"{c}__0")).alias("gap")) for c in cols]
    out = row.select("_k", F.explode(F.array(*parts)).alias("r"))
    return out.where((F.col("r.insight") == "default_rate_pct") | (F.col("_k") == 2)).select("r.*")


def target_correlations(df: DataFrame, label: str = LABEL, top: int = TOP_CORRELATIONS,
                        exclude=()) -> DataFrame:
    """Pearson correlation of every numeric column with the label (pairs
    with a null skipped), one aggregate, highest first, top 15."""
    from riskspark.operators.prep import numeric_columns
    cols = [c for c in numeric_columns(df, exclude=(label, *exclude))]
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c)
                   for c in cols])
    long = row.unpivot([], cols, "feature", "corr") if cols else row
    return (long.where(F.col("corr").isNotNull())
            .orderBy(F.col("corr").desc(), F.col("feature")).limit(top))


def correlation_matrix(df: DataFrame, cols: Sequence[str] = KEY_FEATURES) -> DataFrame:
    """Pairwise-complete correlation of every pair (i, j), one
    aggregate, long form (feature_1, feature_2, corr); diagonal = 1."""
    cols = [c for c in cols if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                   for a, b in pairs])
    parts = [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                      F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    parts += [F.struct(F.lit(b).alias("feature_1"), F.lit(a).alias("feature_2"),
                       F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    parts += [F.struct(F.lit(a).alias("feature_1"), F.lit(a).alias("feature_2"),
                       F.lit(1.0).alias("corr")) for a in cols]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed):
    (by..., bin, bin_lo, bin_hi, n).  min/max are a one-row fit action."""
    mm = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    mn, mx = mm["mn"], mm["mx"]
    if mn is None:
        return df.sparkSession.createDataFrame(
            [], ", ".join([*(f"{b} int" for b in by), "bin int, bin_lo double, bin_hi double, n bigint"]))
    mn, mx = float(mn), float(mx)
    width = mx - mn
    x = F.col(col).cast("double")
    b = (F.lit(0) if width == 0 else
         F.least(F.floor((x - mn) / width * bins), F.lit(bins - 1))).cast("int")
    lo = F.lit(mn) + F.col("bin") * (width / bins)
    return (df.where(x.isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select(*by, "bin", lo.alias("bin_lo"), (lo + width / bins).alias("bin_hi"), "n"))


def box_summary(df: DataFrame, cols: Sequence[str], label: str = LABEL,
                k: float = WHISKER_K) -> DataFrame:
    """Per (label, column): q1, median, q3, fences q1-1.5iqr / q3+1.5iqr,
    whiskers (most extreme values inside the fences) and outlier count.
    Quartiles are exact and known before the rows are read again, so whiskers
    and outliers of all columns are one partial aggregate by label."""
    cols = [c for c in cols if c in df.columns]
    spark = df.sparkSession
    quartiles = {key: q for key, q in exact_quantiles(df, cols, [0.25, 0.5, 0.75], by=label).items() if q[0] is not None}
    fences = {key: (q1 - k * (q3 - q1), q3 + k * (q3 - q1)) for key, (q1, _, q3) in quartiles.items()}

    def fence(c: str, side: int):
        of = F.lit(None).cast("double")
        for (g, name), ends in fences.items():
            if name == c:
                of = F.when(F.col(label).eqNullSafe(F.lit(g)), F.lit(ends[side])).otherwise(of)
        return of

    def box(c: str):
        v = F.col(c).cast("double")
        inside = v.between(fence(c, 0), fence(c, 1))
        return F.struct(F.lit(c).alias("column"), F.min(F.when(inside, v)).alias("whisker_low"),
                        F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))

    boxes = df.groupBy(label).agg(F.array(*[box(c) for c in cols]).alias("boxes")).select(label, F.inline("boxes"))
    names = [label, "column", "q1", "median", "q3", "lower_fence", "upper_fence"]
    stats = spark.createDataFrame([(g, c, *q, *fences[g, c]) for (g, c), q in quartiles.items()], T.StructType(
        [df.schema[label], T.StructField("column", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in names[2:]]]))
    same = F.col(f"s.{label}").eqNullSafe(F.col(f"b.{label}")) & (F.col("s.column") == F.col("b.column"))
    return stats.alias("s").join(boxes.alias("b"), same).select(*[F.col(f"s.{n}") for n in names], "whisker_low", "whisker_high", "n_outliers")


def describe(df: DataFrame, cols: Sequence[str] = DESCRIBE_COLUMNS) -> DataFrame:
    """A3: count, mean, std (n-1), min, 25/50/75 % (exact), max per column."""
    cols = [c for c in cols if c in df.columns]
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    basic = df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(F.col(c).cast("double")).alias("min"),
        *[F.lit(q).cast("double").alias(n) for n, q in zip(("q25", "q50", "q75"), quartiles[None, c])],
        F.max(F.col(c).cast("double")).alias("max")) for c in cols]).alias("columns"))
    return basic.select(F.inline("columns"))


#: Fixed values of the density: grid points, and the exponent of Scott's bandwidth rule in one dimension.
DENSITY_POINTS = 500
SCOTT = -0.2
#: Bins of a bandwidth, and bandwidths that the grid goes beyond the extremes.
DENSITY_BINS, DENSITY_REACH = 20, 6.0


def kernel_density(df: DataFrame, col: str, by: Sequence[str] = (), points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density of a column per group, over all rows:
    (by..., x, n, bandwidth, density) at ``points`` even steps.

    The bandwidth is Scott's, std * n^(-1/5), per group.  Rows are counted in
    bins of a twentieth of the group's bandwidth at most (one partial
    aggregate), each bin keeps its mean, and the small table of bins meets the
    grid: the error against the sum over all rows is of the second order in
    the bin width.  The grid goes six bandwidths beyond the extremes, so the curve's area is 1.  Nulls
    are skipped; a group of one distinct value has no density.
    """
    by = list(by)
    rows = df.select(*by, F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    size = size.where(F.col("std") > 0).withColumn("bandwidth", F.col("std") * F.pow(F.col("n").cast("double"), F.lit(SCOTT))).drop("std")
    size = size.withColumn("width", F.col("bandwidth") / DENSITY_BINS)
    meet = [F.col(f"r.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]
    on = F.lit(True)
    for m in meet:
        on = on & m
    # a handful of groups: as many rows as there are labels
    binned = rows.alias("r").join(F.broadcast(size).alias("s"), on).select(
        *[F.col(f"s.{b}") for b in by], "v", F.floor((F.col("v") - F.col("lo")) / F.col("width")).alias("bin"))
    bins = binned.groupBy(*by, "bin").agg(F.count("*").alias("m"), F.avg("v").alias("v"))
    reach = F.col("bandwidth") * DENSITY_REACH
    step = (F.col("hi") - F.col("lo") + 2 * reach) / (points - 1)
    grid = size.select(*by, "n", "bandwidth", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") - reach + i * step)).alias("x"))
    # a bin beyond eight bandwidths adds less than 1e-14 of its rows
    near = F.abs(F.col("s.x") - F.col("r.v")) <= 8 * F.col("s.bandwidth")
    z = (F.col("s.x") - F.col("r.v")) / F.col("s.bandwidth")
    share = F.col("r.m") / F.col("s.n") * F.exp(-z * z / 2) / (F.col("s.bandwidth") * math.sqrt(2 * math.pi))
    met = F.broadcast(grid).alias("s").join(bins.alias("r"), on & near, "left")
    return met.groupBy(*[F.col(f"s.{b}").alias(b) for b in by], "s.x", "s.n", "s.bandwidth").agg(
        F.coalesce(F.sum(share), F.lit(0.0)).alias("density"))


def scatter_sample(df: DataFrame, x: str, y: str, label: str = LABEL,
                   rows: int = SCATTER_ROWS, seed: int = 42, key: str = KEY) -> DataFrame:
    """A seeded sample of at most 5,000 (x, y, label) points."""
    return (df.orderBy(hash_key(key, seed), F.col(key)).limit(rows)
            .select(key, x, y, label))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50, by: Sequence[str] = (LABEL,)) -> DataFrame:
    """A16 over all rows: (by..., x_bin, y_bin, n, x_min, x_max, y_min, y_max) on an
    even ``bins`` x ``bins`` grid between the extremes (last bins closed); rows
    without x or y are left out.  At most bins^2 rows per group."""
    by = list(by)
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    ends = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()

    def cell(c: str):
        lo, hi = ends[f"{c}0"], ends[f"{c}1"]
        if lo is None or lo == hi:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")

    return rows.groupBy(*by, cell("x").alias("x_bin"), cell("y").alias("y_bin")).agg(
        F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
