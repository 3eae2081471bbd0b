"""Registered queries: descriptive statistics, correlations, histograms, cuts, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.expressions import exact_avg
from ..operators import features as FE
from ..operators import quality as Q
from ..operators import ranking
from ..operators import stats as ST
from ..sources import fixtures, schemas
from . import sql_views as V
from .common import SIG, XAVG, inputs, prep, r, sig
from .q_features import fitted
from .registry import query

LOAN_NUM = ["apr", "nPaidOff", "loanAmount", "leadCost"]

_DESCRIBE_SQL = V.with_("loan", extra=[
    "long AS (UNPIVOT (SELECT " + ", ".join(LOAN_NUM) + " FROM loan) ON " + ", ".join(LOAN_NUM)
    + " INTO NAME feature VALUE value)"]) + f"""
SELECT feature, count(value) AS count, {XAVG('value')} AS mean, {SIG('stddev_samp(value)')} AS std,
       min(value) AS min, {SIG('quantile_cont(value, 0.25)', 12)} AS p25, {SIG('quantile_cont(value, 0.5)', 12)} AS p50,
       {SIG('quantile_cont(value, 0.75)', 12)} AS p75, max(value) AS max
FROM long GROUP BY feature"""


@query("describe_num", _DESCRIBE_SQL)
def describe_num(spark, sf_dir):
    """count, mean, std, min, exact quartiles, max of the numeric loan columns (one pass + one ranking job)."""
    loan, _, _ = inputs(spark, sf_dir)
    d = ST.describe(loan, LOAN_NUM)
    return d.withColumns({"std": sig("std"), **{q: sig(q, 12) for q in ("p25", "p50", "p75")}})


_CORR_COLS = [c for c in V.NUMERIC_BASE if c != "application_hour"]
_CORR_SQL = V.with_("filled", extra=[
    f"t AS (SELECT *, CAST({V._TARGET_CASE} AS DOUBLE) AS target FROM filled)",
    "c AS (UNPIVOT (SELECT " + ", ".join(f"corr({c}, target) AS {c}" for c in _CORR_COLS) + " FROM t) ON "
    + ", ".join(_CORR_COLS) + " INTO NAME feature VALUE corr)"]) + f"""
SELECT feature, round(corr, 9) + 0.0 AS corr FROM c ORDER BY corr DESC LIMIT 10"""


@query("corr_target", _CORR_SQL)
def corr_target(spark, sf_dir):
    """Pearson correlation of each numeric feature with the target in one aggregate; top 10."""
    base, _, spec = fitted(spark, sf_dir)
    df = FE.add_target(FE.fill_missing(base, spec))
    c = ST.corr_with_target(df, _CORR_COLS, "target")
    return ST.topk_by(c, "corr", 10).select("feature", r("corr", 9).alias("corr"))


_CM_COLS = ["apr", "nPaidOff", "loanAmount", "leadCost", "clearfraudscore"]
_CM_PAIRS = [(a, b) for i, a in enumerate(_CM_COLS) for b in _CM_COLS[i:]]
_CM_SQL = V.with_("joined", extra=[
    "c AS (SELECT " + ", ".join(f"corr({a}, {b}) AS c{i}" for i, (a, b) in enumerate(_CM_PAIRS)) + " FROM joined)"]) + \
    " UNION ALL ".join(
        f"SELECT '{a}' AS f1, '{b}' AS f2, round(c{i}, 9) + 0.0 AS corr FROM c" + (
            f" UNION ALL SELECT '{b}' AS f1, '{a}' AS f2, round(c{i}, 9) + 0.0 AS corr FROM c" if a != b else "")
        for i, (a, b) in enumerate(_CM_PAIRS))


@query("corr_matrix", _CM_SQL)
def corr_matrix(spark, sf_dir):
    """Pairwise Pearson matrix (pairwise null deletion) in one aggregate pass."""
    loan, clarity, _ = inputs(spark, sf_dir)
    from ..operators import joins
    df = joins.join_fraud(loan, clarity)
    return ST.corr_matrix(df, _CM_COLS).select("f1", "f2", (r("corr", 9) + F.lit(0.0)).alias("corr"))


_WIDE_COLS = [c for c in V.NUMERIC_BASE if c != "application_hour"] + ["loanAmount_x_apr", "loanAmount_squared", "apr_squared", "clearfraudscore_squared"]
_WIDE_ALL = _WIDE_COLS + ["target"]
_WIDE_PAIRS = [(a, b) for i, a in enumerate(_WIDE_ALL) for b in _WIDE_ALL[i:]]
_WIDE_SQL = V.with_("engineered", extra=[
    f"t AS (SELECT *, CAST({V._TARGET_CASE} AS DOUBLE) AS target FROM engineered)",
    "tc AS (UNPIVOT (SELECT " + ", ".join(f"corr({c}, target) AS {c}" for c in _WIDE_COLS) + " FROM t) ON "
    + ", ".join(_WIDE_COLS) + " INTO NAME feature VALUE corr)",
    "sel AS (SELECT feature FROM (SELECT feature FROM tc ORDER BY corr DESC LIMIT 15) UNION SELECT 'target')",
    "c AS MATERIALIZED (SELECT " + ", ".join(f"corr({a}, {b}) AS c{i}" for i, (a, b) in enumerate(_WIDE_PAIRS)) + " FROM t)",
    "l AS (" + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, c{i} AS corr FROM c" for i, (a, b) in enumerate(_WIDE_PAIRS)) + ")",
    "m AS (SELECT * FROM l UNION ALL SELECT f2, f1, corr FROM l WHERE f1 <> f2)"]) + \
    "SELECT f1, f2, round(corr, 9) + 0.0 AS corr FROM m WHERE f1 IN (SELECT feature FROM sel) AND f2 IN (SELECT feature FROM sel)"


@query("corr_matrix_wide", _WIDE_SQL)
def corr_matrix_wide(spark, sf_dir):
    """Correlation matrix over more than 20 numeric columns: the 15 most correlated with the target, and the target."""
    base, _, spec = fitted(spark, sf_dir)
    df = FE.add_target(FE.add_squares(FE.add_interactions(FE.fill_missing(base, spec), spec), spec))
    cols = ST.shown_columns(df, _WIDE_COLS, "target")
    return ST.corr_matrix(df, cols).select("f1", "f2", (r("corr", 9) + F.lit(0.0)).alias("corr"))


def _hist_sql(src: str, col: str, bins: int, series: str | None = None) -> str:
    ser = f"'{series}' AS series, " if series else ""
    return f"""(WITH mm AS (SELECT min({col}) AS mn, max({col}) AS mx FROM {src}),
  h AS (SELECT CAST(least(floor(({col} - mn) * {float(bins)} / (mx - mn)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
        FROM {src}, mm WHERE {col} IS NOT NULL GROUP BY 1),
  g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT {ser}g.bin, mn + g.bin * ((mx - mn) / {bins}) AS lo, mn + (g.bin + 1) * ((mx - mn) / {bins}) AS hi,
       coalesce(h.n, 0) AS n
FROM g LEFT JOIN h ON g.bin = h.bin, mm)"""


@query("hist_target", V.with_("loan", extra=[f"t AS (SELECT CAST({V._TARGET_CASE} AS DOUBLE) AS target FROM loan)"])
       + "SELECT * FROM " + _hist_sql("t", "target", 20))
def hist_target(spark, sf_dir):
    """20-bin equal-width histogram of the risk target (empty bins included)."""
    loan, _, _ = inputs(spark, sf_dir)
    return ST.histogram(FE.add_target(loan), "target", 20)


@query("hist_pred", V.with_("scored") + "SELECT * FROM " + _hist_sql("scored", "y_true", 30, "actual")
       + " UNION ALL SELECT * FROM " + _hist_sql("scored", "y_pred", 30, "predicted"))
def hist_pred(spark, sf_dir):
    """30-bin histograms of actual and predicted scores."""
    prep(spark)
    s = fixtures.scored(spark, sf_dir)
    a = ST.histogram(s, "y_true", 30).select(F.lit("actual").alias("series"), "*")
    p = ST.histogram(s, "y_pred", 30).select(F.lit("predicted").alias("series"), "*")
    return a.unionByName(p)


def _cut_sql(src: str, col: str, bins: int = 5) -> str:
    """Equal-width cut edges (first edge lowered by 0.1 % of the range), right-closed bins."""
    edges = ["mn - (mx - mn) * 0.001"] + [f"mn + {i} * ((mx - mn) / {bins})" for i in range(1, bins)] + ["mx"]
    case = "CASE WHEN {c} IS NULL OR {c} < {e0} OR {c} > {ek} THEN NULL ".format(c=col, e0=edges[0], ek=edges[-1]) + \
        " ".join(f"WHEN {col} <= {edges[i]} THEN {i - 1}" for i in range(1, len(edges))) + " END"
    return f"CAST({case} AS INTEGER)"


@query("cut5", V.with_("loan", extra=[
    f"t AS (SELECT loanId, CAST({V._TARGET_CASE} AS DOUBLE) AS target FROM loan)",
    "mm AS (SELECT min(target) AS mn, max(target) AS mx FROM t)"])
    + f"SELECT loanId, target, {_cut_sql('t', 'target')} AS target_bin FROM t, mm")
def cut5(spark, sf_dir):
    """Equal-width 5-bin cut of the target, right-closed, lowest edge widened by 0.1 % of the range."""
    loan, _, _ = inputs(spark, sf_dir)
    t = FE.add_target(loan.select("loanId", "loanStatus"))
    out, _ = ST.cut(t, "target", 5)
    return out.select("loanId", "target", "target_bin")


@query("qcut5", V.with_("loan", extra=[
    "edges AS (SELECT list_sort(list_distinct(quantile_cont(loanAmount, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM loan)"])
    + """SELECT loanId, loanAmount,
       CASE WHEN loanAmount IS NULL OR loanAmount < e[1] OR loanAmount > e[-1] THEN NULL
            ELSE CAST(len(list_filter(e[2:], lambda x: x < loanAmount)) AS INTEGER) END AS loanAmount_qbin
FROM loan, edges""")
def qcut5(spark, sf_dir):
    """Quantile cut in 5 (exact linear edges, duplicate edges dropped, lowest edge included)."""
    loan, _, _ = inputs(spark, sf_dir)
    out, _ = ST.qcut(loan.select("loanId", "loanAmount"), "loanAmount", 5)
    return out


_BOX_SQL = V.with_("loan", extra=[
    f"t AS (SELECT loanAmount, CAST({V._TARGET_CASE} AS DOUBLE) AS target FROM loan)",
    "mm AS (SELECT min(target) AS mn, max(target) AS mx FROM t)",
    f"b AS (SELECT {_cut_sql('t', 'target')} AS target_bin, loanAmount FROM t, mm)"]) + f"""
SELECT target_bin, count(loanAmount) AS count, min(loanAmount) AS min, max(loanAmount) AS max,
       {SIG('quantile_cont(loanAmount, 0.25)', 12)} AS q1, {SIG('quantile_cont(loanAmount, 0.5)', 12)} AS median,
       {SIG('quantile_cont(loanAmount, 0.75)', 12)} AS q3
FROM b GROUP BY target_bin"""


@query("eda_box", _BOX_SQL)
def eda_box(spark, sf_dir):
    """Box-plot numbers of the loan amount per 5-bin target cut."""
    loan, _, _ = inputs(spark, sf_dir)
    t = FE.add_target(loan.select("loanAmount", "loanStatus"))
    b, _ = ST.cut(t, "target", 5)
    return ST.box_stats(b, "target_bin", "loanAmount").withColumns({q: sig(q, 12) for q in ("q1", "median", "q3")})


@query("eda_cat_means", V.with_("loan") + f"""
SELECT state, {XAVG(V._TARGET_CASE)} AS mean_target, count(*) AS n FROM loan GROUP BY state""")
def eda_cat_means(spark, sf_dir):
    """Mean target per category, largest first (the sort is a final small-result order)."""
    loan, _, _ = inputs(spark, sf_dir)
    t = FE.add_target(loan)
    return t.groupBy("state").agg(exact_avg("target").alias("mean_target"), F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("mean_target"))


@query("class_balance", V.with_("loan") + """
SELECT originated, count(*) AS n, CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER () AS pct
FROM loan GROUP BY originated""")
def class_balance(spark, sf_dir):
    """Share of each class of the binary outcome in percent."""
    loan, _, _ = inputs(spark, sf_dir)
    return ST.class_balance(loan, "originated")


# ------------------------------------------------------------------------------------------- quality

_DQ_MISSING_SQL = V.with_("dated", extra=[
    "u AS (UNPIVOT (SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in
                                        [f.name for f in schemas.LOAN.fields] + ["underwritingid", "clearfraudscore"]
                                        + list(C.PAYMENT_FEATURES) + list(C.DATE_PART_FEATURES)
                                        + ["days_to_origination"])
    + ", count(*) AS __rows FROM dated) ON COLUMNS(* EXCLUDE (__rows)) INTO NAME column_name VALUE missing)"]) + """
SELECT column_name, missing, CAST(missing AS DOUBLE) * 100.0 / __rows AS missing_pct FROM u"""


def _base(spark, sf_dir):
    loan, clarity, payment = inputs(spark, sf_dir)
    return FE.base_frame(loan, clarity, payment)


@query("dq_missing", _DQ_MISSING_SQL)
def dq_missing(spark, sf_dir):
    """Missing count and percent of every column in one aggregate pass."""
    return Q.missing_counts(_base(spark, sf_dir))


@query("dq_duplicates", V.with_("loan", "payment", "clarity") + """
SELECT 'loan' AS table_name, count(*) AS rows, count(DISTINCT coalesce(loanId, '~null~')) AS distinct_keys,
       count(*) - count(DISTINCT coalesce(loanId, '~null~')) AS duplicates FROM loan
UNION ALL
SELECT 'payment', count(*), count(DISTINCT coalesce(loanId, '~null~')), count(*) - count(DISTINCT coalesce(loanId, '~null~'))
FROM payment
UNION ALL
SELECT 'clarity', count(*), count(DISTINCT coalesce(underwritingid, '~null~')),
       count(*) - count(DISTINCT coalesce(underwritingid, '~null~')) FROM clarity""")
def dq_duplicates(spark, sf_dir):
    """Rows beyond the first per key, per source."""
    loan, clarity, payment = inputs(spark, sf_dir)
    parts = [Q.duplicate_count(loan, "loanId").select(F.lit("loan").alias("table_name"), "*"),
             Q.duplicate_count(payment, "loanId").select(F.lit("payment").alias("table_name"), "*"),
             Q.duplicate_count(clarity, "underwritingid").select(F.lit("clarity").alias("table_name"), "*")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_REQ = {"loan": schemas.LOAN_REQUIRED + ["loanAmount"], "clarity": schemas.CLARITY_REQUIRED,
        "payment": schemas.PAYMENT_REQUIRED + ["principal", "fees", "dueDate"]}


@query("dq_required", V.with_("loan", "clarity", "payment") + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
    + (f"true AS present, count({c}) AS non_null FROM {t}" if c != "dueDate" else
       "false AS present, CAST(0 AS BIGINT) AS non_null")
    for t, cols in _REQ.items() for c in cols))
def dq_required(spark, sf_dir):
    """Required-column presence (absent columns reported, not raised) and non-null counts."""
    loan, clarity, payment = inputs(spark, sf_dir)
    frames = {"loan": loan, "clarity": clarity, "payment": payment}
    out = None
    for t, cols in _REQ.items():
        part = Q.required_columns(frames[t], cols, t)
        out = part if out is None else out.unionByName(part)
    return out


_DTYPES = {**{f.name: f.dataType.simpleString() for f in schemas.LOAN.fields},
           "underwritingid": "string", "clearfraudscore": "double",
           **{c: "double" for c in C.PAYMENT_FEATURES}, **{c: "double" for c in C.DATE_PART_FEATURES},
           "days_to_origination": "double"}


@query("dq_report", _DQ_MISSING_SQL.replace(
    "SELECT column_name, missing, CAST(missing AS DOUBLE) * 100.0 / __rows AS missing_pct FROM u",
    "SELECT column_name, CASE column_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DTYPES.items())
    + f" END AS dtype, missing, CAST(missing AS DOUBLE) * 100.0 / __rows AS missing_pct, {len(_DTYPES)} AS n_columns "
    "FROM u WHERE missing > 0"))
def dq_report(spark, sf_dir):
    """Quality report: columns with missing values, their type, count and percent."""
    return Q.quality_report(_base(spark, sf_dir))


_EXT_COLS = ["loanAmount", "apr", "clearfraudscore", "paymentAmount_sum", "loanAmount_x_apr", "loanAmount_squared",
             "apr_squared", "clearfraudscore_squared"]


@query("dq_extreme", V.with_("engineered") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max, "
    f"abs(max({c})) > 1e6 OR abs(min({c})) > 1e6 AS extreme FROM engineered" for c in _EXT_COLS))
def dq_extreme(spark, sf_dir):
    """Extreme-value flags (|min| or |max| above 1e6) over engineered features."""
    base, _, spec = fitted(spark, sf_dir)
    df = FE.add_squares(FE.add_interactions(FE.fill_missing(base, spec), spec), spec)
    row = df.agg(*[F.min(c).alias(f"mn_{c}") for c in _EXT_COLS], *[F.max(c).alias(f"mx_{c}") for c in _EXT_COLS])
    st = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mn_{c}").alias("min"),
                                                 F.col(f"mx_{c}").alias("max")) for c in _EXT_COLS])).alias("s"))
    return Q.extreme_values(st.select("s.*"))


_GROUP_RULES = [("_squared", "polynomial"), ("_mean", "aggregate"), ("_sum", "aggregate"), ("_count", "aggregate"),
                ("_target_encoded", "encoding"), ("_missing", "indicator")]


def _group_of(c: str) -> str:
    for suf, g in _GROUP_RULES:
        if c.endswith(suf):
            return g
    if "date" in c.lower() or c.startswith("application_"):
        return "date"
    return "other"


# Columns of the fitted feature table on the oracle data (see q_features.features_full).
_FULL_COLUMNS = (["payFrequency", "loanId", "anon_ssn", "apr", "originated", "nPaidOff", "approved", "isFunded",
                  "loanStatus", "loanAmount", "state", "leadType", "leadCost", "clarityFraudId", "underwritingid",
                  "clearfraudscore"] + list(C.PAYMENT_FEATURES)
                 + ["application_year", "application_month", "application_day", "application_dayofweek",
                    "days_to_origination"]
                 + [f"{c}_missing" for c in C.MISSING_INDICATOR_COLUMNS if c not in ("nPaidOff", "apr")]
                 + ["loanAmount_x_apr", "loanAmount_squared", "apr_squared", "clearfraudscore_squared", "target"])


def _col_groups_sql() -> str:
    from .q_features import _FULL_DROPPED
    full = (f"feat_full AS (SELECT * EXCLUDE ({', '.join(_FULL_DROPPED)}), CAST({V._TARGET_CASE} AS DOUBLE) AS target "
            "FROM engineered)")
    return V.with_("engineered", extra=[full]) + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{_group_of(c)}' AS grp, count({c}) AS non_null FROM feat_full" for c in _FULL_COLUMNS)


@query("col_groups", _col_groups_sql())
def col_groups(spark, sf_dir):
    """Column groups of the feature table by suffix / name rule, with non-null counts (rows-only check)."""
    base, pipe, spec = fitted(spark, sf_dir)
    df = pipe.transform(base, spec)
    row = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(_group_of(c)).alias("grp"),
                                                   F.col(c).alias("non_null")) for c in df.columns])).alias("s")) \
        .select("s.*")


@query("sample_head", V.with_("loan") + "SELECT loanId, state, loanAmount, loanStatus FROM loan ORDER BY loanId LIMIT 10")
def sample_head(spark, sf_dir):
    """First rows in key order (top-k by key: per-partition top-k then a small merge)."""
    loan, _, _ = inputs(spark, sf_dir)
    return loan.select("loanId", "state", "loanAmount", "loanStatus").orderBy("loanId").limit(10)
