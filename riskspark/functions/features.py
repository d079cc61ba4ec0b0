"""Row-wise feature derivation (F1-F19) as column expressions.

Every feature appears only when its inputs are present in the frame, so the
output schema follows the columns that survived the null-rate rule.  All
expressions are built-in Catalyst expressions (whole-stage codegen, no UDF).
Divisions use ``try_divide`` so ANSI mode never raises on a zero divisor and
the result is null where pandas would give NaN/inf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the derivation rules.
SENTINEL_DAYS_EMPLOYED = 365243
EXT_COLUMNS = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")
AGE_BIN_EDGES = (0, 25, 35, 45, 55, 100)            # right-closed, codes 0..4
AGE_GROUP_EDGES = (0, 30, 40, 50, 60, 100)          # right-closed
AGE_GROUP_LABELS = ("<30", "30-40", "40-50", "50-60", "60+")
LOG_COLUMNS = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY")
BIRTH_YEAR_BASE = 2024
CREDIT_WEIGHTS = (0.4, 0.3, 0.3)                     # credit, income, annuity


def _nz(c: Column) -> Column:
    """null when zero (pandas ``replace({0: nan})``)."""
    return F.when(c != 0, c)


def _clip_lower0(c: Column) -> Column:
    """``clip(lower=0)`` keeping nulls (``greatest`` alone would skip them)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def right_closed_bins(c: Column, edges, labels) -> Column:
    """pandas ``cut`` with right-closed bins; out of range or null -> null."""
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def income_bins(c: Column, q) -> Column:
    """Quartile bins 0..3 from the fitted edges ``q`` (5 values), right-closed,
    lowest edge included; with repeated edges the first matching bin wins."""
    out = F.when((c >= q[0]) & (c <= q[1]), F.lit(0.0))
    for i in range(1, 4):
        out = out.when((c > q[i]) & (c <= q[i + 1]), F.lit(float(i)))
    return out


def age_group(age: Column) -> Column:
    return right_closed_bins(age, AGE_GROUP_EDGES, AGE_GROUP_LABELS)


def derive_features(df: DataFrame, income_quartiles=None) -> DataFrame:
    """F1-F18 on a cleaned applicant frame (columns above the null limit
    already dropped).  ``income_quartiles`` are the 5 fitted edges of F13;
    without them ``INCOME_BINNED`` is not produced."""
    cols = set(df.columns)
    c = F.col
    new: dict[str, Column] = {}

    if "DAYS_EMPLOYED" in cols:                                         # F1
        df = df.withColumn("DAYS_EMPLOYED", F.when(
            c("DAYS_EMPLOYED") != SENTINEL_DAYS_EMPLOYED, c("DAYS_EMPLOYED")))
    age = -c("DAYS_BIRTH") / 365.0
    emp = -(c("DAYS_EMPLOYED") / 365.0)
    if "DAYS_BIRTH" in cols:                                            # F2
        new["AGE"] = age
    if "DAYS_EMPLOYED" in cols:                                         # F3
        new["EMPLOY_YEARS"] = emp
    cir = F.try_divide(c("AMT_CREDIT"), _nz(c("AMT_INCOME_TOTAL")))
    air = F.try_divide(c("AMT_ANNUITY"), _nz(c("AMT_INCOME_TOTAL")))
    has_cir = {"AMT_CREDIT", "AMT_INCOME_TOTAL"} <= cols
    has_air = {"AMT_ANNUITY", "AMT_INCOME_TOTAL"} <= cols
    if has_cir:                                                         # F4
        new["CREDIT_INCOME_RATIO"] = cir
    if has_air:                                                         # F5
        new["ANNUITY_INCOME_RATIO"] = air

    exts = [e for e in EXT_COLUMNS if e in cols]
    if exts:                                                            # F6
        n = sum((F.when(c(e).isNotNull(), 1).otherwise(0) for e in exts), F.lit(0))
        s = sum((F.coalesce(c(e), F.lit(0.0)) for e in exts), F.lit(0.0))
        mean = F.try_divide(s, F.when(n > 0, n.cast("double")))
        ss = sum((F.coalesce((c(e) - mean) * (c(e) - mean), F.lit(0.0)) for e in exts),
                 F.lit(0.0))
        new["EXT_SOURCES_MEAN"] = mean
        new["EXT_SOURCES_STD"] = F.sqrt(F.try_divide(ss, F.when(n > 1, (n - 1).cast("double"))))
        if len(exts) == 1:
            new["EXT_SOURCES_MAX"] = c(exts[0])
            new["EXT_SOURCES_MIN"] = c(exts[0])
        else:
            new["EXT_SOURCES_MAX"] = F.greatest(*[c(e) for e in exts])
            new["EXT_SOURCES_MIN"] = F.least(*[c(e) for e in exts])

    if has_cir:                                                         # F7
        new["CREDIT_INCOME_RATIO_SQ"] = cir * cir
        new["CREDIT_INCOME_RATIO_SQRT"] = F.sqrt(_clip_lower0(cir))
    if has_air:                                                         # F8
        new["ANNUITY_INCOME_RATIO_SQ"] = air * air
    if {"DAYS_BIRTH", "DAYS_EMPLOYED"} <= cols:                         # F9, F10
        new["AGE_EMPLOY_INTERACTION"] = age * emp
        new["AGE_EMPLOY_RATIO"] = F.try_divide(age, _nz(emp) + 1)
    if {"AMT_CREDIT", "AMT_ANNUITY"} <= cols:                           # F11
        new["CREDIT_ANNUITY_RATIO"] = F.try_divide(c("AMT_CREDIT"), _nz(c("AMT_ANNUITY")))
        new["CREDIT_ANNUITY_DIFF"] = c("AMT_CREDIT") - c("AMT_ANNUITY")
    if "DAYS_BIRTH" in cols:                                            # F12
        new["AGE_BINNED"] = right_closed_bins(age, AGE_BIN_EDGES, [0.0, 1.0, 2.0, 3.0, 4.0])
    if "AMT_INCOME_TOTAL" in cols and income_quartiles is not None:     # F13
        new["INCOME_BINNED"] = income_bins(c("AMT_INCOME_TOTAL"), income_quartiles)
    if {"AMT_CREDIT", "AMT_ANNUITY", "AMT_INCOME_TOTAL"} <= cols:        # F14, F15
        new["TOTAL_AMOUNT"] = c("AMT_CREDIT") + c("AMT_ANNUITY") + c("AMT_INCOME_TOTAL")
        wc, wi, wa = CREDIT_WEIGHTS
        new["WEIGHTED_CREDIT_SCORE"] = (c("AMT_CREDIT") * wc + c("AMT_INCOME_TOTAL") * wi
                                        + c("AMT_ANNUITY") * wa)
    if "DAYS_BIRTH" in cols:                                            # F16, F17
        new["DAYS_BIRTH_ABS"] = F.abs(c("DAYS_BIRTH"))
        new["BIRTH_YEAR"] = (c("DAYS_BIRTH") / -365.25).cast("bigint") + BIRTH_YEAR_BASE
    for m in LOG_COLUMNS:                                               # F18
        if m in cols:
            new[f"{m}_LOG"] = F.log1p(_clip_lower0(c(m)))
    return df.withColumns(new)
