"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the Spark code: plain SQL over the given tables,
with window functions and scalar subqueries where that is simplest.  The
fitted schema at the checked scale is written out (``EXT_SOURCE_1`` is above
the 40 % null limit and dropped).
"""

from __future__ import annotations

from riskspark.operators.ensemble import BLEND_GRID
from riskspark.operators.evaluate import METRIC_THRESHOLDS, PROFIT_THRESHOLDS
from riskspark.functions.scores import SCORES_SQL
from riskspark.sources.tables import APPLICATIONS_SQL

HASH = "((SK_ID_CURR) * 2654435761 + 42) % 4294967296"

KEPT_RAW = ["SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY",
            "AMT_GOODS_PRICE", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "EXT_SOURCE_2", "EXT_SOURCE_3",
            "DAYS_BIRTH", "DAYS_EMPLOYED", "CODE_GENDER", "NAME_INCOME_TYPE", "OCCUPATION_TYPE",
            "ORGANIZATION_TYPE", "WEEKDAY_APPR_PROCESS_START", "HOUR_APPR_PROCESS_START",
            "REGION_RATING_CLIENT"]
STRING_COLS = ["CODE_GENDER", "NAME_INCOME_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE"]
DERIVED = ["AGE", "EMPLOY_YEARS", "CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO",
           "EXT_SOURCES_MEAN", "EXT_SOURCES_STD", "EXT_SOURCES_MAX", "EXT_SOURCES_MIN",
           "CREDIT_INCOME_RATIO_SQ", "CREDIT_INCOME_RATIO_SQRT", "ANNUITY_INCOME_RATIO_SQ",
           "AGE_EMPLOY_INTERACTION", "AGE_EMPLOY_RATIO", "CREDIT_ANNUITY_RATIO",
           "CREDIT_ANNUITY_DIFF", "AGE_BINNED", "INCOME_BINNED", "TOTAL_AMOUNT",
           "WEIGHTED_CREDIT_SCORE", "DAYS_BIRTH_ABS", "BIRTH_YEAR", "AMT_INCOME_TOTAL_LOG",
           "AMT_CREDIT_LOG", "AMT_ANNUITY_LOG"]
FEATURE_COLS = KEPT_RAW + DERIVED
NUMERIC_COLS = [c for c in FEATURE_COLS if c not in STRING_COLS and c not in ("SK_ID_CURR", "TARGET")]
LOG_COLS = ["AMT_INCOME_TOTAL_LOG", "AMT_CREDIT_LOG", "AMT_ANNUITY_LOG"]
CAP_COLS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CREDIT_INCOME_RATIO"]

APPS_CTE = f"applications AS ({APPLICATIONS_SQL})"


def _sorted(c: str) -> str:
    """The column's values in order, without nulls."""
    return f"list_sort(list(CAST({c} AS DOUBLE)) FILTER ({c} IS NOT NULL))"


def _quantile(s: str, p: float) -> str:
    """Linear interpolation between the neighbours in a sorted list, from the nearer one."""
    at = f"((len({s}) - 1) * CAST({p!r} AS DOUBLE))"
    lo, hi = f"{s}[CAST(floor({at}) AS BIGINT) + 1]", f"{s}[CAST(ceil({at}) AS BIGINT) + 1]"
    d = f"({at} - floor({at}))"
    return f"CASE WHEN {d} >= 0.5e0 THEN {hi} - ({hi} - {lo}) * (1 - {d}) ELSE {lo} + ({hi} - {lo}) * {d} END"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# F1-F18 over the applications view (values unrounded; logs rounded in reports)
FEATS_CTE = f"""
fa AS (
  SELECT SK_ID_CURR, TARGET, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, AMT_GOODS_PRICE,
    CNT_CHILDREN, CNT_FAM_MEMBERS, EXT_SOURCE_2, EXT_SOURCE_3, DAYS_BIRTH,
    CASE WHEN DAYS_EMPLOYED <> 365243 THEN DAYS_EMPLOYED END AS DAYS_EMPLOYED,
    CODE_GENDER, NAME_INCOME_TYPE, OCCUPATION_TYPE, ORGANIZATION_TYPE,
    WEEKDAY_APPR_PROCESS_START, HOUR_APPR_PROCESS_START, REGION_RATING_CLIENT
  FROM applications),
fq AS (SELECT [{", ".join(_quantile("s", p) for p in (0.0, 0.25, 0.5, 0.75, 1.0))}] AS q
       FROM (SELECT {_sorted("AMT_INCOME_TOTAL")} AS s FROM applications) t),
fb AS (
  SELECT fa.*,
    CAST(-DAYS_BIRTH AS DOUBLE) / 365.0e0 AS AGE,
    -(CAST(DAYS_EMPLOYED AS DOUBLE) / 365.0e0) AS EMPLOY_YEARS,
    AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) AS CREDIT_INCOME_RATIO,
    AMT_ANNUITY / NULLIF(AMT_INCOME_TOTAL, 0) AS ANNUITY_INCOME_RATIO,
    (CASE WHEN EXT_SOURCE_2 IS NOT NULL THEN 1 ELSE 0 END
     + CASE WHEN EXT_SOURCE_3 IS NOT NULL THEN 1 ELSE 0 END) AS en,
    (0.0e0 + coalesce(EXT_SOURCE_2, 0.0e0)) + coalesce(EXT_SOURCE_3, 0.0e0) AS es
  FROM fa),
fc AS (SELECT fb.*, es / NULLIF(CAST(en AS DOUBLE), 0) AS EXT_SOURCES_MEAN FROM fb),
features AS (
  SELECT SK_ID_CURR, TARGET, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, AMT_GOODS_PRICE,
    CNT_CHILDREN, CNT_FAM_MEMBERS, EXT_SOURCE_2, EXT_SOURCE_3, DAYS_BIRTH, DAYS_EMPLOYED,
    CODE_GENDER, NAME_INCOME_TYPE, OCCUPATION_TYPE, ORGANIZATION_TYPE,
    WEEKDAY_APPR_PROCESS_START, HOUR_APPR_PROCESS_START, REGION_RATING_CLIENT,
    AGE, EMPLOY_YEARS, CREDIT_INCOME_RATIO, ANNUITY_INCOME_RATIO, EXT_SOURCES_MEAN,
    sqrt(((0.0e0 + coalesce((EXT_SOURCE_2 - EXT_SOURCES_MEAN) * (EXT_SOURCE_2 - EXT_SOURCES_MEAN), 0.0e0))
           + coalesce((EXT_SOURCE_3 - EXT_SOURCES_MEAN) * (EXT_SOURCE_3 - EXT_SOURCES_MEAN), 0.0e0))
         / CASE WHEN en > 1 THEN CAST(en - 1 AS DOUBLE) END) AS EXT_SOURCES_STD,
    greatest(EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCES_MAX,
    least(EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCES_MIN,
    CREDIT_INCOME_RATIO * CREDIT_INCOME_RATIO AS CREDIT_INCOME_RATIO_SQ,
    sqrt(CASE WHEN CREDIT_INCOME_RATIO IS NOT NULL THEN greatest(CREDIT_INCOME_RATIO, 0.0e0) END) AS CREDIT_INCOME_RATIO_SQRT,
    ANNUITY_INCOME_RATIO * ANNUITY_INCOME_RATIO AS ANNUITY_INCOME_RATIO_SQ,
    AGE * EMPLOY_YEARS AS AGE_EMPLOY_INTERACTION,
    AGE / NULLIF(NULLIF(EMPLOY_YEARS, 0) + 1, 0) AS AGE_EMPLOY_RATIO,
    AMT_CREDIT / NULLIF(AMT_ANNUITY, 0) AS CREDIT_ANNUITY_RATIO,
    AMT_CREDIT - AMT_ANNUITY AS CREDIT_ANNUITY_DIFF,
    CASE WHEN AGE > 0 AND AGE <= 25 THEN 0.0e0 WHEN AGE > 25 AND AGE <= 35 THEN 1.0e0
         WHEN AGE > 35 AND AGE <= 45 THEN 2.0e0 WHEN AGE > 45 AND AGE <= 55 THEN 3.0e0
         WHEN AGE > 55 AND AGE <= 100 THEN 4.0e0 END AS AGE_BINNED,
    CASE WHEN AMT_INCOME_TOTAL >= q[1] AND AMT_INCOME_TOTAL <= q[2] THEN 0.0e0
         WHEN AMT_INCOME_TOTAL > q[2] AND AMT_INCOME_TOTAL <= q[3] THEN 1.0e0
         WHEN AMT_INCOME_TOTAL > q[3] AND AMT_INCOME_TOTAL <= q[4] THEN 2.0e0
         WHEN AMT_INCOME_TOTAL > q[4] AND AMT_INCOME_TOTAL <= q[5] THEN 3.0e0 END AS INCOME_BINNED,
    AMT_CREDIT + AMT_ANNUITY + AMT_INCOME_TOTAL AS TOTAL_AMOUNT,
    AMT_CREDIT * 0.4e0 + AMT_INCOME_TOTAL * 0.3e0 + AMT_ANNUITY * 0.3e0 AS WEIGHTED_CREDIT_SCORE,
    abs(DAYS_BIRTH) AS DAYS_BIRTH_ABS,
    CAST(trunc(DAYS_BIRTH / -365.25e0) AS BIGINT) + 2024 AS BIRTH_YEAR,
    ln(1 + CASE WHEN AMT_INCOME_TOTAL IS NOT NULL THEN greatest(AMT_INCOME_TOTAL, 0.0e0) END) AS AMT_INCOME_TOTAL_LOG,
    ln(1 + CASE WHEN AMT_CREDIT IS NOT NULL THEN greatest(AMT_CREDIT, 0.0e0) END) AS AMT_CREDIT_LOG,
    ln(1 + CASE WHEN AMT_ANNUITY IS NOT NULL THEN greatest(AMT_ANNUITY, 0.0e0) END) AS AMT_ANNUITY_LOG
  FROM fc, fq)"""


# B1: the stratified split by hash order
SPLIT_CTES = (
    "cnt AS (SELECT TARGET, count(*) AS c FROM applications GROUP BY TARGET), "
    "tot AS (SELECT sum(c) AS n, sum(c) - CAST(ceil(0.2e0 * sum(c)) AS BIGINT) AS n_train FROM cnt), "
    "al AS (SELECT cnt.TARGET, cnt.c, floor(CAST(cnt.c * tot.n_train AS DOUBLE) / tot.n) AS fl, "
    "CAST(cnt.c * tot.n_train AS DOUBLE) / tot.n - floor(CAST(cnt.c * tot.n_train AS DOUBLE) / tot.n) AS rem, "
    "tot.n_train FROM cnt, tot), "
    "al2 AS (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, TARGET) AS rr FROM al), "
    "alloc AS (SELECT TARGET, c - CAST(fl + CASE WHEN rr <= need THEN 1 ELSE 0 END AS BIGINT) AS k_test FROM al2), "
    f"ranked AS (SELECT a.*, row_number() OVER (PARTITION BY a.TARGET ORDER BY {HASH}) AS rn FROM applications a), "
    "split AS (SELECT r.*, CASE WHEN r.rn <= alloc.k_test THEN 'test' ELSE 'train' END AS split "
    "FROM ranked r JOIN alloc ON r.TARGET = alloc.TARGET)")


def _prepared_ctes(fit: str = "all") -> list[str]:
    """``fit``: the rows that medians, caps and codes come from (all, or the train part)."""
    med = ", ".join(f"{_quantile(f's_{c}', 0.5)} AS {c}" for c in NUMERIC_COLS)
    lists = ", ".join(f"{_sorted(c)} AS s_{c}" for c in NUMERIC_COLS)
    imp = ", ".join(f"coalesce(CAST(features.{c} AS DOUBLE), pm.{c}) AS {c}" for c in NUMERIC_COLS)
    strs = ", ".join(f"features.{c}" for c in STRING_COLS)
    capq = ", ".join(f"{_quantile(f's_{c}', 0.25)} AS q1_{c}, {_quantile(f's_{c}', 0.75)} AS q3_{c}" for c in CAP_COLS)
    caps = ", ".join(f"{_sorted(c)} AS s_{c}" for c in CAP_COLS)
    of = lambda t: t if fit == "all" else (f"(SELECT {t}.* FROM {t} JOIN split sp ON {t}.SK_ID_CURR = sp.SK_ID_CURR "  # noqa: E731
                                           f"WHERE sp.split = '{fit}') {t}_fit")
    ctes = [f"pm AS (SELECT {med} FROM (SELECT {lists} FROM {of('features')}) t)",
            f"pi AS (SELECT features.SK_ID_CURR, features.TARGET, {imp}, {strs} FROM features, pm)",
            f"pq AS (SELECT {capq} FROM (SELECT {caps} FROM {of('pi')}) t)"]
    for c in STRING_COLS:
        ctes.append(f"code_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code "
                    f"FROM (SELECT DISTINCT coalesce({c}, 'MISSING') AS v FROM {of('features')}) t)")
    sel = []
    for c in NUMERIC_COLS:
        if c in CAP_COLS:
            lo = f"(pq.q1_{c} - 1.5e0 * (pq.q3_{c} - pq.q1_{c}))"
            hi = f"(pq.q3_{c} + 1.5e0 * (pq.q3_{c} - pq.q1_{c}))"
            sel.append(f"CASE WHEN pi.{c} IS NOT NULL THEN least(greatest(pi.{c}, {lo}), {hi}) END AS {c}")
        else:
            sel.append(f"pi.{c}")
    sel += [f"coalesce(code_{c}.code, -1) AS {c}" for c in STRING_COLS]
    joins = " ".join(f"LEFT JOIN code_{c} ON code_{c}.v = coalesce(pi.{c}, 'MISSING')" for c in STRING_COLS)
    ctes.append(f"prepared AS (SELECT pi.SK_ID_CURR, pi.TARGET, {', '.join(sel)} FROM pi CROSS JOIN pq {joins})")
    return ctes


PREPARED_FEATURES = [c for c in FEATURE_COLS if c not in ("SK_ID_CURR", "TARGET")]


def _base(*extra: str, features=False, prepared=False, scores=False, fit="all") -> str:
    ctes = [APPS_CTE]
    if fit != "all":
        ctes.append(SPLIT_CTES)
    if features or prepared:
        ctes.append(FEATS_CTE if fit == "all" else FEATS_CTE.replace("FROM applications) t)", f"FROM split WHERE split = '{fit}') t)"))
    if prepared:
        ctes += _prepared_ctes(fit)
    if scores:
        ctes.append(f"scored AS ({SCORES_SQL})")
    return _with(*ctes, *extra)


def _features_report_select() -> str:
    cols = []
    for c in FEATURE_COLS:
        cols.append(f"round({c}, 6) AS {c}" if c in LOG_COLS else c)
    return "SELECT " + ", ".join(cols) + " FROM features"


def _lit_list(xs) -> str:
    return "[" + ", ".join(repr(float(x)) + "::DOUBLE" for x in xs) + "]"


def _metric_cols(tp="tp", tn="tn", fp="fp", fn="fn") -> str:
    r = lambda n, d: f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0.0e0 END"
    return ", ".join([
        f"{r(f'{tp} + {tn}', f'{tp} + {tn} + {fp} + {fn}')} AS accuracy",
        f"{r(tp, f'{tp} + {fp}')} AS precision",
        f"{r(tp, f'{tp} + {fn}')} AS recall",
        f"{r(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1_score",
        f"{r(tn, f'{tn} + {fp}')} AS specificity"])


def _counts(score: str, t: float | str, label: str = "TARGET") -> str:
    p = f"{score} >= {t}"
    return (f"CAST(sum(CASE WHEN {label} = 1 AND {p} THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
            f"CAST(sum(CASE WHEN {label} = 0 AND NOT ({p}) THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
            f"CAST(sum(CASE WHEN {label} = 0 AND {p} THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            f"CAST(sum(CASE WHEN {label} = 1 AND NOT ({p}) THEN 1 ELSE 0 END) AS BIGINT) AS fn")


def _auc_sql(src: str, score: str, by: str = "") -> str:
    """Exact tied AUC by average ranks (Mann-Whitney) over ``src``."""
    byc = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return (f"(SELECT {byc}CASE WHEN sum(TARGET) > 0 AND sum(1 - TARGET) > 0 THEN "
            f"(sum(CASE WHEN TARGET = 1 THEN rk ELSE 0 END) - sum(TARGET) * (sum(TARGET) + 1) / 2.0e0)"
            f" / (CAST(sum(TARGET) AS DOUBLE) * CAST(sum(1 - TARGET) AS DOUBLE)) END AS roc_auc "
            f"FROM (SELECT {byc}TARGET, rank() OVER ({part}ORDER BY {score}) "
            f"+ (count(*) OVER ({part}ORDER BY {score} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0e0 AS rk "
            f"FROM {src}) r {grp})")


def _sweep_sql(src: str, score: str, thresholds, by: str = "") -> str:
    byc = f"{by}, " if by else ""
    return (f"(SELECT {byc}t AS threshold, {_counts(score, 't')} "
            f"FROM {src} CROSS JOIN (SELECT unnest({_lit_list(thresholds)}) AS t) th "
            f"GROUP BY {byc}t)")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    A = _base()
    FE = _base(features=True)
    PR = _base(prepared=True)
    SC = _base(scores=True)

    # --- sources / sampling -------------------------------------------------
    q["applications"] = A + "SELECT * FROM applications"
    q["sample_rows"] = A + f"SELECT * FROM applications ORDER BY {HASH}, SK_ID_CURR LIMIT 1000"
    q["csv_roundtrip"] = q["applications"]
    q["sample_info"] = A + ("SELECT count(*) AS total_rows, CAST(least(count(*), 1000) AS BIGINT) AS sample_rows, "
                            "count(*) > 1000 AS is_sampled FROM applications")
    # --- quality --------------------------------------------------------------
    rules = {"AMT_INCOME_TOTAL": (0, None), "AMT_CREDIT": (0, None), "AMT_ANNUITY": (0, None),
             "CNT_CHILDREN": (0, 20), "EXT_SOURCE_2": (0, 1), "EXT_SOURCE_3": (0, 1)}
    parts = []
    for c, (lo, hi) in rules.items():
        b = f"CAST(sum(CASE WHEN {c} < {lo} THEN 1 ELSE 0 END) AS BIGINT)" if lo is not None else "CAST(0 AS BIGINT)"
        a = f"CAST(sum(CASE WHEN {c} > {hi} THEN 1 ELSE 0 END) AS BIGINT)" if hi is not None else "CAST(0 AS BIGINT)"
        lo_s = f"CAST({lo} AS DOUBLE)" if lo is not None else "CAST(NULL AS DOUBLE)"
        hi_s = f"CAST({hi} AS DOUBLE)" if hi is not None else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", {lo_s} AS min_allowed, {hi_s} AS max_allowed, "
                     f"{b} AS n_below, {a} AS n_above FROM applications")
    q["range_checks"] = A + ("SELECT *, n_below = 0 AND n_above = 0 AS valid FROM (" +
                             " UNION ALL ".join(parts) + ") t")
    req = ("req AS (SELECT SK_ID_CURR, AMT_INCOME_TOTAL AS amt_income_total, AMT_CREDIT AS amt_credit, "
           "AMT_ANNUITY AS amt_annuity, CNT_CHILDREN AS cnt_children, EXT_SOURCE_2 AS ext_source_2, "
           "EXT_SOURCE_3 AS ext_source_3, CAST(-DAYS_BIRTH AS DOUBLE) / 365.0e0 AS age, "
           "CASE WHEN DAYS_EMPLOYED <> 365243 THEN -(CAST(DAYS_EMPLOYED AS DOUBLE) / 365.0e0) END AS employ_years "
           "FROM applications)")
    checks = [
        ("amt_income_total", "amt_income_total IS NOT NULL AND amt_income_total > 0"),
        ("amt_credit", "amt_credit IS NOT NULL AND amt_credit > 0"),
        ("amt_annuity", "amt_annuity IS NOT NULL AND amt_annuity >= 0"),
        ("cnt_children", "coalesce(cnt_children, 0) BETWEEN 0 AND 20"),
        ("ext_source_2", "ext_source_2 IS NULL OR ext_source_2 BETWEEN 0 AND 1"),
        ("ext_source_3", "ext_source_3 IS NULL OR ext_source_3 BETWEEN 0 AND 1"),
        ("age", "age IS NOT NULL AND age BETWEEN 18 AND 100"),
        ("employ_years", "coalesce(employ_years, 0.0e0) BETWEEN 0 AND 50")]
    failed = "concat_ws(',', " + ", ".join(
        f"CASE WHEN NOT coalesce({cond}, false) THEN '{n}' END" for n, cond in checks) + ")"
    chk = f"chk AS (SELECT req.*, {failed} AS failed_rules FROM req)"
    q["record_checks"] = _base(req, chk) + "SELECT *, failed_rules = '' AS accepted FROM chk"
    q["batch_summary"] = _base(req, chk) + (
        "SELECT count(*) AS n_records, CAST(sum(CASE WHEN failed_rules = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted, "
        "count(*) - CAST(sum(CASE WHEN failed_rules = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected FROM chk")
    app_cols = [c for c in ["SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY",
                            "AMT_GOODS_PRICE", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "EXT_SOURCE_1",
                            "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_BIRTH", "DAYS_EMPLOYED", "CODE_GENDER",
                            "NAME_INCOME_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE",
                            "WEEKDAY_APPR_PROCESS_START", "HOUR_APPR_PROCESS_START", "REGION_RATING_CLIENT"]]
    ns = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
        f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_rate FROM applications"
        for i, c in enumerate(app_cols))
    q["frame_checks"] = A + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {str(have).lower()} AS present, count(*) AS n_rows, {n} AS n_values, {n} > 0 AS usable FROM applications"
        for c in ("SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "EXT_SOURCE_1", "NAME_HOUSING_TYPE")
        for have in (c in app_cols,) for n in (f"count({c})" if have else "CAST(0 AS BIGINT)",))
    q["batch_size"] = A + ("SELECT count(*) AS n_records, CAST(1 AS BIGINT) AS least, CAST(10000 AS BIGINT) AS most, "
                           "count(*) BETWEEN 1 AND 10000 AS within FROM applications")
    q["null_top"] = A + (f"SELECT \"column\", null_count, null_rate FROM ({ns}) t WHERE null_count > 0 "
                         "ORDER BY null_count DESC, \"column\" LIMIT 20")
    q["null_limit"] = A + f"SELECT \"column\", null_rate, null_rate <= 0.4 AS kept FROM ({ns}) t"
    null_cols = ["AMT_ANNUITY", "AMT_GOODS_PRICE", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2",
                 "EXT_SOURCE_3", "OCCUPATION_TYPE"]
    q["null_by_target"] = A + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", TARGET, avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS null_rate "
        f"FROM applications GROUP BY TARGET" for c in null_cols)
    q["missing_pattern"] = A + (
        "SELECT flags.*, count(*) AS n_rows FROM (SELECT " + ", ".join(f"{c} IS NULL AS {c}" for c in null_cols) +
        " FROM applications) flags GROUP BY ALL")
    feat_null_cols = [c for c in FEATURE_COLS]
    q["total_nulls"] = FE + ("SELECT CAST(" + " + ".join(f"(count(*) - count({c}))" for c in feat_null_cols)
                             + " AS BIGINT) AS total_nulls FROM features")
    # --- features / prep --------------------------------------------------------
    q["features"] = FE + _features_report_select()
    q["prepared"] = PR + ("SELECT * EXCLUDE (" + ", ".join(LOG_COLS) + "), " +
                          ", ".join(f"round({c}, 6) AS {c}" for c in LOG_COLS) + " FROM prepared")
    later = _base(prepared=True, fit="train") + (
        "SELECT p.* EXCLUDE (" + ", ".join(LOG_COLS) + "), " + ", ".join(f"round(p.{c}, 6) AS {c}" for c in LOG_COLS) +
        " FROM prepared p JOIN split sp ON p.SK_ID_CURR = sp.SK_ID_CURR WHERE sp.split = 'test'")
    q["prepared_later_batch"] = later
    q["prepared_unlike_batch"] = ("SELECT * REPLACE (0.0e0 AS AMT_GOODS_PRICE, CAST(CASE WHEN SK_ID_CURR % 3 = 0 THEN -1 "
                                  "ELSE CODE_GENDER END AS INT) AS CODE_GENDER) FROM (" + later + ") t")
    sc_cols = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CREDIT_INCOME_RATIO", "AGE", "EXT_SOURCES_MEAN"]
    q["scaled"] = PR + ("SELECT SK_ID_CURR, " + ", ".join(
        f"round((p.{c} - s.m_{c}) / CASE WHEN s.s_{c} <> 0 THEN s.s_{c} ELSE 1.0e0 END, 6) AS {c}" for c in sc_cols)
        + " FROM prepared p, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in sc_cols)
        + " FROM prepared) s")
    # --- profiling ----------------------------------------------------------------
    q["overview"] = FE + (f"SELECT count(*) AS n_rows, CAST({len(FEATURE_COLS)} AS BIGINT) AS n_columns, "
                          "CAST(sum(TARGET) AS BIGINT) AS n_default, avg(CAST(TARGET AS DOUBLE)) * 100 AS default_rate_pct, "
                          "(1 - avg(CAST(TARGET AS DOUBLE))) * 100 AS non_default_rate_pct FROM features")
    q["label_counts"] = A + ("SELECT TARGET, count(*) AS n, count(*) / sum(count(*)) OVER () AS share "
                             "FROM applications GROUP BY TARGET")
    rate = "avg(CAST(TARGET AS DOUBLE)) AS default_rate, count(*) AS n"
    q["rate_by_income_type"] = A + (f"SELECT NAME_INCOME_TYPE, {rate} FROM applications GROUP BY NAME_INCOME_TYPE "
                                    "HAVING count(*) >= 100 ORDER BY default_rate DESC, NAME_INCOME_TYPE")
    q["rate_by_organization_top15"] = A + (
        f"SELECT ORGANIZATION_TYPE, {rate} FROM applications GROUP BY ORGANIZATION_TYPE "
        "HAVING count(*) >= 500 ORDER BY default_rate DESC, ORGANIZATION_TYPE LIMIT 15")
    dims = ["OCCUPATION_TYPE", "CNT_CHILDREN", "WEEKDAY_APPR_PROCESS_START", "HOUR_APPR_PROCESS_START",
            "REGION_RATING_CLIENT"]
    q["rate_by_dimension"] = A + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, {rate} FROM applications GROUP BY {d}"
        for d in dims)
    q["rate_by_family_size"] = A + (f"SELECT CNT_FAM_MEMBERS, {rate} FROM applications "
                                    "WHERE CNT_FAM_MEMBERS <= 6 GROUP BY CNT_FAM_MEMBERS")
    q["rate_by_age_group"] = FE + (
        "SELECT CASE WHEN AGE > 0 AND AGE <= 30 THEN '<30' WHEN AGE > 30 AND AGE <= 40 THEN '30-40' "
        "WHEN AGE > 40 AND AGE <= 50 THEN '40-50' WHEN AGE > 50 AND AGE <= 60 THEN '50-60' "
        f"WHEN AGE > 60 AND AGE <= 100 THEN '60+' END AS AGE_GROUP, {rate} FROM features GROUP BY 1")
    q["crosstab_gender"] = A + ("SELECT CODE_GENDER, avg(CASE WHEN TARGET = 0 THEN 1.0e0 ELSE 0.0e0 END) * 100 AS pct_0, "
                                "avg(CASE WHEN TARGET = 1 THEN 1.0e0 ELSE 0.0e0 END) * 100 AS pct_1 "
                                "FROM applications GROUP BY CODE_GENDER")
    q["label_means"] = FE + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", TARGET, round(avg({c}), 6) AS mean FROM features GROUP BY TARGET"
        for c in ["AMT_INCOME_TOTAL", "EXT_SOURCE_2", "AGE"])
    ins = ["EXT_SOURCE_2", "AMT_INCOME_TOTAL", "AGE"]
    q["insights"] = FE + (
        "SELECT 'default_rate_pct' AS insight, CAST(NULL AS DOUBLE) AS non_default, "
        "round(avg(CAST(TARGET AS DOUBLE)) * 100, 6) AS \"default\", CAST(NULL AS DOUBLE) AS gap FROM features UNION ALL " +
        " UNION ALL ".join(
            f"SELECT '{c}', round(avg(CASE WHEN TARGET = 0 THEN {c} END), 6), round(avg(CASE WHEN TARGET = 1 THEN {c} END), 6), "
            f"round(avg(CASE WHEN TARGET = 1 THEN {c} END) - avg(CASE WHEN TARGET = 0 THEN {c} END), 6) FROM features "
            f"HAVING count(DISTINCT TARGET) = 2" for c in ins))
    corr_cols = [c for c in NUMERIC_COLS] + ["SK_ID_CURR"]
    q["target_correlations"] = FE + (
        "SELECT feature, round(\"corr\", 9) AS \"corr\" FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(TARGET AS DOUBLE)) AS \"corr\" FROM features"
            for c in corr_cols) + ") t WHERE \"corr\" IS NOT NULL ORDER BY \"corr\" DESC, feature LIMIT 15")
    kf = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CNT_CHILDREN", "EXT_SOURCE_2", "EXT_SOURCE_3",
          "AGE", "EMPLOY_YEARS"]
    pairs = []
    for i, a in enumerate(kf):
        pairs.append(f"SELECT '{a}' AS feature_1, '{a}' AS feature_2, 1.0e0 AS \"corr\"")
        for b in kf[i + 1:]:
            e = f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 9)"
            pairs.append(f"SELECT '{a}', '{b}', (SELECT {e} FROM features)")
            pairs.append(f"SELECT '{b}', '{a}', (SELECT {e} FROM features)")
    q["correlation_matrix"] = FE + " UNION ALL ".join(pairs)
    q["histogram_credit"] = FE + (
        "SELECT bin, round(mn + bin * ((mx - mn) / 50), 6) AS bin_lo, round(mn + bin * ((mx - mn) / 50) + (mx - mn) / 50, 6) AS bin_hi, "
        "count(*) AS n FROM (SELECT CAST(least(floor((AMT_CREDIT - mn) / (mx - mn) * 50), 49) AS INT) AS bin, mn, mx "
        "FROM features, (SELECT min(AMT_CREDIT) AS mn, max(AMT_CREDIT) AS mx FROM features) m "
        "WHERE AMT_CREDIT IS NOT NULL) t GROUP BY bin, mn, mx")
    q["histogram_age_by_label"] = FE + (
        "SELECT TARGET, bin, round(mn + bin * ((mx - mn) / 30), 6) AS bin_lo, round(mn + bin * ((mx - mn) / 30) + (mx - mn) / 30, 6) AS bin_hi, "
        "count(*) AS n FROM (SELECT TARGET, CAST(least(floor((AGE - mn) / (mx - mn) * 30), 29) AS INT) AS bin, mn, mx "
        "FROM features, (SELECT min(AGE) AS mn, max(AGE) AS mx FROM features) m "
        "WHERE AGE IS NOT NULL) t GROUP BY TARGET, bin, mn, mx")
    box_cols = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AGE"]
    box = []
    for c in box_cols:
        box.append(
            f"SELECT TARGET, '{c}' AS \"column\", q1, median, q3, lf AS lower_fence, uf AS upper_fence, "
            f"min(CASE WHEN v BETWEEN lf AND uf THEN v END) AS whisker_low, "
            f"max(CASE WHEN v BETWEEN lf AND uf THEN v END) AS whisker_high, "
            f"CAST(sum(CASE WHEN v BETWEEN lf AND uf THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers FROM "
            f"(SELECT f.TARGET, CAST(f.{c} AS DOUBLE) AS v, s.* FROM features f JOIN "
            f"(SELECT *, q1 - 1.5e0 * (q3 - q1) AS lf, q3 + 1.5e0 * (q3 - q1) AS uf FROM (SELECT TARGET AS t, "
            f"{_quantile('s', 0.25)} AS q1, {_quantile('s', 0.5)} AS median, {_quantile('s', 0.75)} AS q3 "
            f"FROM (SELECT TARGET, {_sorted(c)} AS s FROM features GROUP BY TARGET) l) q) s ON f.TARGET = s.t WHERE f.{c} IS NOT NULL) x "
            f"GROUP BY TARGET, q1, median, q3, lf, uf")
    q["box_summary"] = FE + " UNION ALL ".join(box)
    dcols = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CNT_CHILDREN"]
    q["describe"] = FE + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", n AS count, mean, std, mn AS min, {_quantile('s', 0.25)} AS q25, {_quantile('s', 0.5)} AS q50, "
        f"{_quantile('s', 0.75)} AS q75, mx AS max FROM (SELECT count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx, {_sorted(c)} AS s FROM features) t" for c in dcols)
    q["density_ext_by_label"] = FE + (
        "SELECT TARGET, round(x, 6) AS x, n, round(bandwidth, 6) AS bandwidth, round(density, 6) AS density FROM ("
        "WITH size AS (SELECT TARGET, count(*) AS n, min(EXT_SOURCE_2) AS lo, max(EXT_SOURCE_2) AS hi, "
        "stddev_samp(EXT_SOURCE_2) * pow(CAST(count(*) AS DOUBLE), -0.2e0) AS bandwidth FROM features WHERE EXT_SOURCE_2 IS NOT NULL GROUP BY TARGET), "
        "bins AS (SELECT f.TARGET, count(*) AS m, avg(EXT_SOURCE_2) AS v FROM features f JOIN size ON f.TARGET = size.TARGET "
        "WHERE EXT_SOURCE_2 IS NOT NULL GROUP BY f.TARGET, floor((EXT_SOURCE_2 - lo) / (bandwidth / 20))), "
        "grid AS (SELECT *, lo - 6 * bandwidth + i * ((hi - lo + 12 * bandwidth) / 499) AS x FROM size, range(500) r(i)) "
        "SELECT grid.TARGET, x, n, bandwidth, sum(m / n * exp(-pow((x - v) / bandwidth, 2) / 2) / (bandwidth * sqrt(2 * pi()))) AS density "
        "FROM grid JOIN bins ON grid.TARGET = bins.TARGET GROUP BY grid.TARGET, x, n, bandwidth) d")
    q["scatter_sample"] = A + (f"SELECT SK_ID_CURR, AMT_INCOME_TOTAL, AMT_CREDIT, TARGET FROM applications "
                               f"ORDER BY {HASH}, SK_ID_CURR LIMIT 5000")
    q["scatter_bins"] = A + (
        "SELECT TARGET, CAST(least(floor((x - x0) / (x1 - x0) * 50), 49) AS INT) AS x_bin, CAST(least(floor((y - y0) / (y1 - y0) * 50), 49) AS INT) AS y_bin, "
        "count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM (SELECT TARGET, AMT_INCOME_TOTAL AS x, AMT_CREDIT AS y, "
        "min(AMT_INCOME_TOTAL) OVER () AS x0, max(AMT_INCOME_TOTAL) OVER () AS x1, min(AMT_CREDIT) OVER () AS y0, max(AMT_CREDIT) OVER () AS y1 "
        "FROM applications WHERE AMT_INCOME_TOTAL IS NOT NULL AND AMT_CREDIT IS NOT NULL) t GROUP BY ALL")
    # --- split / weights -------------------------------------------------------------
    split = SPLIT_CTES
    q["split_rows"] = _base(split) + "SELECT SK_ID_CURR, TARGET, split FROM split"
    q["split_summary"] = _base(split) + "SELECT split, TARGET, count(*) AS n FROM split GROUP BY split, TARGET"
    q["class_weights"] = _base(split) + (
        "SELECT TARGET, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight "
        "FROM split WHERE split = 'train' GROUP BY TARGET")
    q["positive_weight"] = _base(split) + (
        "SELECT CAST(sum(CASE WHEN TARGET = 0 THEN 1 ELSE 0 END) AS DOUBLE) / "
        "NULLIF(CAST(sum(CASE WHEN TARGET = 1 THEN 1 ELSE 0 END) AS DOUBLE), 0) AS scale_pos_weight "
        "FROM split WHERE split = 'train'")
    # --- evaluation on the deterministic scores -----------------------------------------
    q["scores"] = SC + "SELECT * FROM scored"
    q["metrics"] = SC + (f"SELECT {_metric_cols()}, tp, tn, fp, fn, auc.roc_auc FROM "
                         f"(SELECT {_counts('p_logistic', 0.5)} FROM scored) c, {_auc_sql('scored', 'p_logistic')} auc")
    q["roc_auc"] = SC + f"SELECT roc_auc FROM {_auc_sql('scored', 'p_logistic')} a"
    q["roc_curve"] = SC + (
        "SELECT s AS threshold, CASE WHEN N > 0 THEN CAST(cn AS DOUBLE) / N ELSE 0.0e0 END AS fpr, "
        "CASE WHEN P > 0 THEN CAST(cp AS DOUBLE) / P ELSE 0.0e0 END AS tpr FROM ("
        "SELECT s, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn, "
        "sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM ("
        "SELECT p_logistic AS s, sum(TARGET) AS pos, sum(1 - TARGET) AS neg FROM scored GROUP BY p_logistic) g) t")
    q["confusion_matrix"] = SC + (
        "SELECT a.actual, a.predicted, CAST(count(s.SK_ID_CURR) AS BIGINT) AS n FROM "
        "(SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted)) a "
        "LEFT JOIN scored s ON s.TARGET = a.actual AND CASE WHEN s.p_logistic >= 0.5 THEN 1 ELSE 0 END = a.predicted "
        "GROUP BY a.actual, a.predicted")
    rep = ("c AS (SELECT " + _counts("p_logistic", 0.5) + " FROM scored), "
           "m AS (SELECT tp, tn, fp, fn, "
           "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0e0 END AS p1, "
           "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0e0 END AS r1, "
           "CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0.0e0 END AS p0, "
           "CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0.0e0 END AS r0, "
           "CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0 FROM c), "
           "m2 AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0e0 END AS f0, "
           "CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0e0 END AS f1, s0 + s1 AS n FROM m)")
    q["class_report"] = _base(rep, scores=True) + (
        "SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM m2 UNION ALL "
        "SELECT '1', p1, r1, f1, s1 FROM m2 UNION ALL "
        "SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m2 UNION ALL "
        "SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM m2")
    sweep16 = _sweep_sql("scored", "p_logistic", METRIC_THRESHOLDS)
    q["threshold_metrics"] = SC + f"SELECT threshold, {_metric_cols()}, tp, tn, fp, fn FROM {sweep16} s"
    q["best_f1_threshold"] = SC + (f"SELECT threshold, {_metric_cols()}, tp, tn, fp, fn FROM {sweep16} s "
                                   "ORDER BY f1_score DESC, threshold LIMIT 1")
    q["metrics_at_threshold"] = SC + (f"SELECT {_metric_cols()}, tp, tn, fp, fn FROM "
                                      f"(SELECT {_counts('p_logistic', 0.35)} FROM scored) c")
    sweep80 = _sweep_sql("scored", "p_logistic", PROFIT_THRESHOLDS)
    prof = ("SELECT threshold, CAST(tp + tn + fp AS DOUBLE) * 1000.0e0 - CAST(fp AS DOUBLE) * 500.0e0 "
            "- CAST(fn AS DOUBLE) * 2000.0e0 AS profit, CAST(tp + tn + fp AS BIGINT) AS approvals, tp, tn, fp, fn ")
    q["profit_curve"] = SC + prof + f"FROM {sweep80} s"
    q["best_profit_threshold"] = SC + prof + f"FROM {sweep80} s ORDER BY profit DESC, threshold LIMIT 1"
    best = f"best AS ({prof} FROM {sweep80} s ORDER BY profit DESC, threshold LIMIT 1)"
    q["cost_breakdown"] = _base(best, scores=True) + (
        "SELECT threshold, 1 AS line, 'Revenue (True Positives)' AS category, CAST(tp * 1000.0e0 AS DOUBLE) AS amount FROM best UNION ALL "
        "SELECT threshold, 2, 'Revenue (Other Approvals)', CAST((tn + fp) * 1000.0e0 AS DOUBLE) FROM best UNION ALL "
        "SELECT threshold, 3, 'Cost (False Positives)', CAST(-fp * 500.0e0 AS DOUBLE) FROM best UNION ALL "
        "SELECT threshold, 4, 'Cost (False Negatives)', CAST(-fn * 2000.0e0 AS DOUBLE) FROM best UNION ALL "
        "SELECT threshold, 5, 'Net Profit', profit FROM best")
    dflt = f"dflt AS ({prof} FROM {_sweep_sql('scored', 'p_logistic', [0.5])} s)"
    q["default_vs_best"] = _base(best, dflt, scores=True) + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, CAST(d.{c} AS DOUBLE) AS \"default\", CAST(b.{c} AS DOUBLE) AS optimal, "
        f"CAST(b.{c} AS DOUBLE) - CAST(d.{c} AS DOUBLE) AS improvement FROM best b, dflt d"
        for c in ["threshold", "profit", "approvals", "fp", "fn"])
    longsc = ("long AS (SELECT 'logistic' AS model, TARGET, p_logistic AS score FROM scored UNION ALL "
              "SELECT 'tree', TARGET, p_tree FROM scored UNION ALL SELECT 'forest', TARGET, p_forest FROM scored)")
    cmp_ = (f"cmp AS (SELECT c.model, {_metric_cols()}, tp, tn, fp, fn, a.roc_auc FROM "
            f"(SELECT model, {_counts('score', 0.5)} FROM long GROUP BY model) c "
            f"JOIN {_auc_sql('long', 'score', 'model')} a ON c.model = a.model)")
    q["model_comparison"] = _base(longsc, cmp_, scores=True) + "SELECT * FROM cmp"
    mets = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
    unp = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM cmp" for m in mets)
    q["best_per_metric"] = _base(longsc, cmp_, scores=True) + (
        f"SELECT metric, model AS best_model, value FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY metric ORDER BY value DESC, model) AS r FROM ({unp}) u) t WHERE r = 1")
    # --- ensembles ------------------------------------------------------------------
    w = [0.3, 0.2, 0.2]
    wn = [x / sum(w) for x in w]
    soft = f"((0.0e0 + p_logistic * {wn[0]!r}) + p_tree * {wn[1]!r}) + p_forest * {wn[2]!r}"
    q["soft_vote"] = SC + (f"SELECT SK_ID_CURR, TARGET, p_logistic, p_tree, p_forest, {soft} AS p_soft, "
                           f"CAST({soft} >= 0.5 AS INT) AS pred_soft FROM scored")
    hv = (f"((0.0e0 + CAST(p_logistic >= 0.5 AS INT) * {wn[0]!r}) + CAST(p_tree >= 0.5 AS INT) * {wn[1]!r}) "
          f"+ CAST(p_forest >= 0.5 AS INT) * {wn[2]!r}")
    q["hard_vote"] = SC + (f"SELECT SK_ID_CURR, TARGET, p_logistic, p_tree, p_forest, {hv} AS vote, "
                           f"CAST({hv} >= 0.5 AS INT) AS pred_hard FROM scored")
    bw = [0.5, 0.5, 0.2]
    bn = [x / sum(bw) for x in bw]
    bl = f"((0.0e0 + p_logistic * {bn[0]!r}) + p_tree * {bn[1]!r}) + p_forest * {bn[2]!r}"
    q["blend"] = SC + (f"SELECT SK_ID_CURR, TARGET, p_logistic, p_tree, p_forest, {bl} AS p_blend, "
                       f"CAST({bl} >= 0.5 AS INT) AS pred_blend FROM scored")
    bsrc = (f"(SELECT w, TARGET, w * p_logistic + (1 - w) * p_tree AS p FROM scored "
            f"CROSS JOIN (SELECT unnest({_lit_list(BLEND_GRID)}) AS w) g)")
    q["blend_weight_auc"] = SC + f"SELECT * FROM {_auc_sql(bsrc, 'p', 'w')} a"
    q["ensemble_metrics"] = SC + (
        f"SELECT {_metric_cols()}, tp, tn, fp, fn, auc.roc_auc FROM "
        f"(SELECT {_counts('p_soft', 0.5)} FROM (SELECT *, {soft} AS p_soft FROM scored) x) c, "
        f"{_auc_sql(f'(SELECT TARGET, {soft} AS p_soft FROM scored)', 'p_soft')} auc")
    # --- bands ------------------------------------------------------------------------
    q["risk_bands"] = SC + (
        "SELECT SK_ID_CURR, p_logistic, CASE WHEN p_logistic > 0.7 THEN 'High' WHEN p_logistic > 0.3 THEN 'Medium' "
        "ELSE 'Low' END AS band_batch, CASE WHEN p_logistic < 0.3 THEN 'Low' WHEN p_logistic < 0.7 THEN 'Medium' "
        "ELSE 'High' END AS band_api, CASE WHEN p_logistic > 0.5 THEN 'High Risk' ELSE 'Low Risk' END AS band_two_level "
        "FROM scored")
    q["band_counts"] = SC + (
        "SELECT band, count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT CASE WHEN p_logistic > 0.7 THEN 'High' "
        "WHEN p_logistic > 0.3 THEN 'Medium' ELSE 'Low' END AS band FROM scored) t GROUP BY band")
    q["api_features"] = _base(req) + (
        "SELECT SK_ID_CURR, CAST(amt_income_total AS DOUBLE) AS AMT_INCOME_TOTAL, CAST(amt_credit AS DOUBLE) AS AMT_CREDIT, "
        "CAST(amt_annuity AS DOUBLE) AS AMT_ANNUITY, CAST(coalesce(cnt_children, 0) AS DOUBLE) AS CNT_CHILDREN, "
        "coalesce(NULLIF(ext_source_2, 0), 0.5e0) AS EXT_SOURCE_2, coalesce(NULLIF(ext_source_3, 0), 0.5e0) AS EXT_SOURCE_3, "
        "age AS AGE, coalesce(employ_years, 0.0e0) AS EMPLOY_YEARS FROM req")
    # --- selection ------------------------------------------------------------------------
    feats = PREPARED_FEATURES
    anova = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, TARGET AS y, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM prepared GROUP BY TARGET"
        for c in feats)
    af = (f"per AS ({anova}), tot AS (SELECT feature AS tf, sum(n) AS n_all, count(*) AS n_classes, "
          "sum(n * m) / sum(n) AS mean_all FROM per GROUP BY feature), "
          "anova AS (SELECT per.feature, (sum(n * (m - mean_all) * (m - mean_all)) / (n_classes - 1)) / "
          "NULLIF(sum(n * v) / (n_all - n_classes), 0) AS f_score "
          "FROM per JOIN tot ON per.feature = tot.tf GROUP BY per.feature, n_all, n_classes)")
    q["anova_f"] = _base(af, prepared=True) + "SELECT feature, round(f_score, 6) AS f_score FROM anova"
    q["k_best"] = q["anova_f"].rsplit("SELECT feature", 1)[0] + (
        "SELECT feature, round(f_score, 6) AS f_score FROM anova ORDER BY f_score DESC NULLS LAST, feature LIMIT 20")
    mi_parts = []
    for c in feats:
        mi_parts.append(
            f"SELECT '{c}' AS feature, TARGET AS y, "
            f"(SELECT count(*) FROM unnest(cuts) AS u(x) WHERE u.x < CAST(p.{c} AS DOUBLE)) AS b "
            f"FROM prepared p, (SELECT [{', '.join(_quantile('s', i / 10) for i in range(1, 10))}] AS cuts "
            f"FROM (SELECT {_sorted(c)} AS s FROM prepared) l) q WHERE p.{c} IS NOT NULL")
    mi = (f"bins AS ({' UNION ALL '.join(mi_parts)}), "
          "cnt AS (SELECT feature, b, y, count(*) AS n_by FROM bins GROUP BY feature, b, y), "
          "cnt2 AS (SELECT *, sum(n_by) OVER (PARTITION BY feature) AS n, sum(n_by) OVER (PARTITION BY feature, b) AS n_b, "
          "sum(n_by) OVER (PARTITION BY feature, y) AS n_y FROM cnt)")
    q["mutual_info"] = _base(mi, prepared=True) + (
        "SELECT feature, round(sum((CAST(n_by AS DOUBLE) / n) * ln(CAST(n_by * n AS DOUBLE) / CAST(n_b * n_y AS DOUBLE))), 9) "
        "AS mutual_info FROM cnt2 GROUP BY feature")
    # --- explanation on the deterministic linear model ---------------------------------------
    lin = ("lin AS (SELECT SK_ID_CURR, CASE WHEN AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) IS NULL OR "
           "AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) > 10 THEN 10e0 ELSE AMT_CREDIT / NULLIF(AMT_INCOME_TOTAL, 0) END / 10 AS credit_ratio_capped, "
           "coalesce(EXT_SOURCE_2, 0.5e0) AS ext_source_2_filled FROM applications), "
           "bg AS (SELECT avg(credit_ratio_capped) AS m1, avg(ext_source_2_filled) AS m2 FROM lin), "
           "ex AS (SELECT * FROM lin)")
    q["linear_shap_summary"] = _base(lin) + (
        "SELECT 'credit_ratio_capped' AS feature, round(avg(abs(0.8e0 * (credit_ratio_capped - m1))), 9) AS mean_abs_shap "
        "FROM ex, bg UNION ALL SELECT 'ext_source_2_filled', round(avg(abs(-1.5e0 * (ext_source_2_filled - m2))), 9) FROM ex, bg")
    q["linear_shap_breakdown"] = _base(lin) + (
        "SELECT SK_ID_CURR, round(0.8e0 * m1 - 1.5e0 * m2, 9) AS base, round(0.8e0 * credit_ratio_capped - 1.5e0 * ext_source_2_filled, 9) AS logit, "
        "CAST(row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(p.part) DESC, p.feature) AS INT) AS rank, p.feature, round(p.value, 9) AS value, "
        "round(p.part, 9) AS part FROM (SELECT *, unnest([{'feature': 'credit_ratio_capped', 'value': credit_ratio_capped, 'part': 0.8e0 * (credit_ratio_capped - m1)}, "
        "{'feature': 'ext_source_2_filled', 'value': ext_source_2_filled, 'part': -1.5e0 * (ext_source_2_filled - m2)}]) AS p FROM ex, bg) t")
    # --- k-NN (M6) and SMOTE counts (B4): brute force over all pairs (oracle only) ---------
    fs = PREPARED_FEATURES
    scale = ", ".join(f"(p.{c} - st.m_{c}) / CASE WHEN st.s_{c} <> 0 THEN st.s_{c} ELSE 1.0e0 END AS {c}"
                      for c in fs)
    knn = (
        "parts AS (SELECT p.*, sp.split FROM prepared p JOIN split sp ON p.SK_ID_CURR = sp.SK_ID_CURR), "
        "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(stddev_pop({c}), 0) AS s_{c}" for c in fs)
        + " FROM parts WHERE split = 'train'), "
        f"sc AS (SELECT p.SK_ID_CURR, p.TARGET, p.split, {scale} FROM parts p, st), "
        "pairs AS (SELECT q.SK_ID_CURR AS qk, t.SK_ID_CURR AS nk, CAST(t.TARGET AS DOUBLE) AS ny, "
        + " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in fs)
        + " AS d2 FROM sc q, sc t WHERE q.split = 'test' AND t.split = 'train'), "
        "nn AS (SELECT qk, nk, ny, d2, row_number() OVER (PARTITION BY qk ORDER BY d2, nk) AS rank "
        "FROM pairs QUALIFY rank <= 5)")
    q["knn_neighbours"] = _base(knn, prepared=True, fit="train") + (
        "SELECT qk AS SK_ID_CURR, CAST(rank AS INT) AS rank, nk AS neighbour, ny AS neighbour_label, "
        "round(sqrt(d2), 6) AS distance FROM nn")
    q["model_knn"] = _base(knn, prepared=True, fit="train") + (
        "SELECT sc.SK_ID_CURR, sc.TARGET, avg(nn.ny) AS p_knn, CAST(avg(nn.ny) >= 0.5 AS INT) AS pred_knn "
        "FROM nn JOIN sc ON sc.SK_ID_CURR = nn.qk GROUP BY sc.SK_ID_CURR, sc.TARGET")
    q["smote_balance"] = _base(split + ", c AS (SELECT TARGET, count(*) AS n FROM split "
                               "WHERE split = 'train' GROUP BY TARGET)") + (
        "SELECT TARGET, false AS synthetic, n FROM c UNION ALL "
        "SELECT TARGET, true AS synthetic, (SELECT max(n) FROM c) - n AS n FROM c "
        "WHERE n < (SELECT max(n) FROM c)")
    return q
