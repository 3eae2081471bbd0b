"""Registered queries: evaluation metrics, model comparison, deployment gate and registry.

Input: the ``scored`` view (deterministic pseudo-scores per order; ``run_id`` = order month). ``y_pred``
plays the production model, ``y_alt`` a challenger.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import evaluate as EV
from ..operators import gate as GT
from ..operators import ranking
from ..sources import fixtures
from . import sql_views as V
from .common import SIG, XAVG, XSUM, prep, r, scratch_path, sig
from .registry import query

SD = 9   # significant digits of values that come from double sums
RD = 12  # digits for ratios averaged over a few labels (summation order differs between engines)


def _scored(spark, sf_dir):
    prep(spark)
    return fixtures.scored(spark, sf_dir)


def _band(x: str, limits: tuple[float, float] = EV.LIMITS) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {limits[0]} THEN 0 WHEN {x} > {limits[1]} THEN 2 ELSE 1 END"


def eval_ctes(y: str = "y_true", p: str = "y_pred", g: list[str] | None = None, prefix: str = "",
              limits: tuple[float, float] = EV.LIMITS) -> list[str]:
    """SQL CTE items computing the same metrics as ``operators.evaluate.evaluate``."""
    g = list(g or [])
    gk = ", ".join(g)
    gsel = (gk + ", ") if g else ""
    gby = ("GROUP BY " + gk) if g else ""
    P = prefix
    return [
        f"""{P}reg AS (SELECT {gsel}count(*) AS n, {XSUM(f'({y} - {p}) * ({y} - {p})')} AS sse,
              {XSUM(f'abs({y} - {p})')} AS sae, var_pop({y}) * count(*) AS sst FROM scored {gby})""",
        f"""{P}regm AS (SELECT {gsel}n, sse / n AS mse, sae / n AS mae,
              CASE WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 - sse / sst END AS r2 FROM {P}reg)""",
        f"""{P}cnt AS (SELECT {gsel}{_band(y, limits)} AS actual, {_band(p, limits)} AS predicted, count(*) AS n FROM scored
              WHERE {y} IS NOT NULL AND {p} IS NOT NULL GROUP BY ALL)""",
        f"""{P}lab AS (SELECT DISTINCT {gsel}actual AS label FROM {P}cnt UNION SELECT DISTINCT {gsel}predicted FROM {P}cnt)""",
        f"""{P}pc AS (SELECT {", ".join("l." + c for c in g + ["label"])},
              coalesce(sum(c.n) FILTER (WHERE c.actual = l.label AND c.predicted = l.label), 0) AS tp,
              coalesce(sum(c.n) FILTER (WHERE c.actual = l.label), 0) AS support,
              coalesce(sum(c.n) FILTER (WHERE c.predicted = l.label), 0) AS predicted_n
            FROM {P}lab l JOIN {P}cnt c ON {" AND ".join(f"l.{c} = c.{c}" for c in g) if g else "true"}
            GROUP BY ALL)""",
        f"""{P}pc2 AS (SELECT *, CASE WHEN predicted_n = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted_n END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall FROM {P}pc)""",
        f"""{P}pc3 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
              ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM {P}pc2)""",
        f"""{P}clsm AS (SELECT {gsel}CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, avg(precision) AS precision_macro,
              avg(recall) AS recall_macro, avg(f1) AS f1_macro FROM {P}pc3 {gby})""",
        f"""{P}ev AS (SELECT a.*, b.* EXCLUDE ({gk + ", " if g else ""}dummy) FROM {P}regm a JOIN
              (SELECT *, 0 AS dummy FROM {P}clsm) b ON {" AND ".join(f"a.{c} = b.{c}" for c in g) if g else "true"})""",
    ]


def _metric_cols(prefix: str = "") -> str:
    return (f"{SIG('mse', SD)} AS mse, {SIG('mae', SD)} AS mae, {SIG('r2', SD)} AS r2, accuracy, round(precision_macro, {RD}) AS precision_macro, "
            f"round(recall_macro, {RD}) AS recall_macro, round(f1_macro, {RD}) AS f1_macro")


def _round_metrics(df):
    return df.withColumns({c: r(c, RD) for c in ("precision_macro", "recall_macro", "f1_macro")} | {c: sig(c, SD) for c in ("mse", "mae", "r2") if c in df.columns})


@query("eval_regression", V.with_("scored", extra=eval_ctes()[:2]) + f"SELECT n, {SIG('mse', SD)} AS mse, {SIG('mae', SD)} AS mae, {SIG('r2', SD)} AS r2 FROM regm")
def eval_regression(spark, sf_dir):
    """MSE, MAE, R² from exact sums (one pass)."""
    m = EV.regression_metrics(_scored(spark, sf_dir))
    return m.withColumns({c: sig(c, SD) for c in ("mse", "mae", "r2")})


@query("eval_macro", V.with_("scored", extra=eval_ctes()) + f"""
SELECT accuracy, round(precision_macro, {RD}) AS precision_macro, round(recall_macro, {RD}) AS recall_macro,
       round(f1_macro, {RD}) AS f1_macro FROM clsm""")
def eval_macro(spark, sf_dir):
    """Accuracy and macro precision/recall/F1 on the 3 risk bands (from confusion counts)."""
    s = _scored(spark, sf_dir)
    return _round_metrics(EV.classification_metrics(EV.band_counts(s)))


DEPLOY_LIMITS = (0.25, 0.6)  # band limits of a deployment's own configuration


@query("eval_limits", V.with_("scored", extra=eval_ctes(limits=DEPLOY_LIMITS)) + f"SELECT n, {_metric_cols()} FROM ev")
def eval_limits(spark, sf_dir):
    """Regression and banded metrics with the band limits of the deployment configuration."""
    return _round_metrics(EV.evaluate(_scored(spark, sf_dir), limits=DEPLOY_LIMITS))


@query("eval_confusion", V.with_("scored", extra=eval_ctes()) + """
SELECT a.label AS actual, b.label AS predicted, coalesce(c.n, 0) AS n
FROM lab a CROSS JOIN lab b LEFT JOIN cnt c ON c.actual = a.label AND c.predicted = b.label""")
def eval_confusion(spark, sf_dir):
    """Confusion matrix (rows true, columns predicted) over the union of labels, zeros included."""
    s = _scored(spark, sf_dir)
    return EV.confusion_matrix(EV.band_counts(s))


@query("eval_class_report", V.with_("scored", extra=eval_ctes()) + f"""
SELECT CAST(label AS VARCHAR) AS label, round(precision, {RD}) AS precision, round(recall, {RD}) AS recall,
       round(f1, {RD}) AS f1, CAST(support AS BIGINT) AS support FROM pc3
UNION ALL SELECT 'macro avg', round(avg(precision), {RD}), round(avg(recall), {RD}), round(avg(f1), {RD}),
       CAST(sum(support) AS BIGINT) FROM pc3
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), {RD}),
       round(sum(recall * support) / sum(support), {RD}), round(sum(f1 * support) / sum(support), {RD}),
       CAST(sum(support) AS BIGINT) FROM pc3""")
def eval_class_report(spark, sf_dir):
    """Per-class precision/recall/F1/support plus macro and support-weighted averages."""
    s = _scored(spark, sf_dir)
    rep = EV.class_report(EV.band_counts(s))
    return rep.withColumns({c: r(c, RD) for c in ("precision", "recall", "f1")}) \
        .withColumn("support", F.col("support").cast("bigint"))


_PCT_SQL = V.with_("scored", extra=[
    "pv AS (SELECT y_pred AS v, count(*) AS w FROM scored WHERE y_pred IS NOT NULL GROUP BY 1)",
    "na AS (SELECT count(y_true) AS n FROM scored)",
    """pr AS (SELECT pv.v, pv.w,
          (SELECT count(*) FROM scored s WHERE s.y_true < pv.v) AS lt,
          (SELECT count(*) FROM scored s WHERE s.y_true <= pv.v) AS le FROM pv)""",
    """pp AS (SELECT w, CAST(lt + le + CASE WHEN le > lt THEN 1 ELSE 0 END AS DOUBLE) * 50.0 / na.n / 100.0 AS pct
          FROM pr, na)""",
    f"ps AS (SELECT {XSUM('pct * w')} AS s1, sum(w) AS n, min(pct) AS pct_min, max(pct) AS pct_max FROM pp)",
    "sd AS (SELECT sqrt(sum(w * pow(pct - (SELECT s1 / n FROM ps), 2)) / sum(w)) AS pct_std FROM pp)",
    f"pm AS (SELECT {XAVG('y_pred')} AS mean_prediction, stddev_pop(y_pred) AS std_prediction FROM scored)"]) + f"""
SELECT {SIG('s1 / n', SD)} AS pct_mean, {SIG('pct_min', SD)} AS pct_min, {SIG('pct_max', SD)} AS pct_max, {SIG('pct_std', SD)} AS pct_std,
       {SIG('mean_prediction', SD)} AS mean_prediction, {SIG('std_prediction', SD)} AS std_prediction
FROM ps, sd, pm"""


@query("eval_percentile", _PCT_SQL)
def eval_percentile(spark, sf_dir):
    """Percentile of every prediction within the actuals (rank rule) summarised, via distributed
    running counts instead of a per-prediction scan of all actuals."""
    out = EV.percentile_summary(_scored(spark, sf_dir))
    return out.select(*[sig(c, SD).alias(c) for c in out.columns])


@query("eval_band_share", V.with_("scored") + f"""
SELECT 'predicted' AS series,
       count(*) FILTER (WHERE {_band('y_pred')} = 0) * 100.0 / count(*) AS low_risk,
       count(*) FILTER (WHERE {_band('y_pred')} = 1) * 100.0 / count(*) AS medium_risk,
       count(*) FILTER (WHERE {_band('y_pred')} = 2) * 100.0 / count(*) AS high_risk FROM scored
UNION ALL SELECT 'actual',
       count(*) FILTER (WHERE {_band('y_true')} = 0) * 100.0 / count(*),
       count(*) FILTER (WHERE {_band('y_true')} = 1) * 100.0 / count(*),
       count(*) FILTER (WHERE {_band('y_true')} = 2) * 100.0 / count(*) FROM scored""")
def eval_band_share(spark, sf_dir):
    """Percent of predictions and of actuals in each risk band."""
    s = _scored(spark, sf_dir)
    return EV.band_shares(s, "y_pred").select(F.lit("predicted").alias("series"), "*").unionByName(
        EV.band_shares(s, "y_true").select(F.lit("actual").alias("series"), "*"))


_CMP_SQL = V.with_("scored", extra=eval_ctes("y_true", "y_alt", prefix="n_") + eval_ctes("y_true", "y_pred", prefix="o_")) + f"""
SELECT {SIG('o.mse - n.mse', SD)} AS mse_diff, {SIG('o.mae - n.mae', SD)} AS mae_diff, {SIG('n.r2 - o.r2', SD)} AS r2_diff, n.accuracy - o.accuracy AS accuracy_diff,
       round(n.precision_macro - o.precision_macro, {RD}) AS precision_macro_diff,
       round(n.recall_macro - o.recall_macro, {RD}) AS recall_macro_diff,
       round(n.f1_macro - o.f1_macro, {RD}) AS f1_macro_diff,
       n.r2 - o.r2 > {C.IMPROVEMENT_THRESHOLD} AND n.accuracy - o.accuracy > 0 AS is_better
FROM n_ev n, o_ev o"""


@query("eval_compare", _CMP_SQL)
def eval_compare(spark, sf_dir):
    """Challenger vs production on the same rows: sign-aware diffs and the is-better rule."""
    s = _scored(spark, sf_dir)
    c = EV.compare(EV.evaluate(s, "y_true", "y_alt"), EV.evaluate(s, "y_true", "y_pred"))
    return c.withColumns({k: r(k, RD) for k in ("precision_macro_diff", "recall_macro_diff", "f1_macro_diff")}
                         | {k: sig(k, SD) for k in ("mse_diff", "mae_diff", "r2_diff")})


_RUN_METRICS_SQL = V.with_("scored", extra=eval_ctes(g=["run_id"])) + f"""
SELECT run_id, metric, value FROM (UNPIVOT (SELECT run_id, {_metric_cols()} FROM ev)
  ON mse, mae, r2, accuracy, precision_macro, recall_macro, f1_macro INTO NAME metric VALUE value)"""


@query("eval_metrics", _RUN_METRICS_SQL)
def eval_metrics(spark, sf_dir):
    """Evaluation-result sink: metrics per run in long format, appended under ``run_id`` and read back."""
    s = _scored(spark, sf_dir)
    wide = _round_metrics(EV.evaluate(s, group_cols=["run_id"]))
    path = scratch_path(spark, "eval-metrics")
    EV.metrics_long(wide, ["run_id"]).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.parquet(path).select("run_id", "metric", "value")


def _gated(spark, sf_dir):
    """Per run: challenger (y_alt) metrics, comparison with production (y_pred), gate, decision."""
    s = _scored(spark, sf_dir)
    new = _round_metrics(EV.evaluate(s, "y_true", "y_alt", ["run_id"]))
    old = EV.evaluate(s, "y_true", "y_pred", ["run_id"]).select("run_id", F.col("r2").alias("prod_r2"))
    j = new.join(old, "run_id", "inner")
    # Runs are one row each (months): the first run has no production model yet.
    first = j.agg(F.min("run_id").alias("__first"))
    j = ranking.join_small(j, first, [], 1)
    has_prod = F.col("run_id") != F.col("__first")
    g = GT.gate(j, has_prod, F.col("r2") - F.col("prod_r2"))
    return GT.decision(g, has_prod).drop("__first")


_GATE_CTES = eval_ctes("y_true", "y_alt", ["run_id"], prefix="n_") + eval_ctes("y_true", "y_pred", ["run_id"], prefix="o_") + [
    f"""gt AS (SELECT n.run_id, n.accuracy, n.r2, round(n.precision_macro, {RD}) AS precision_macro, o.r2 AS prod_r2,
           n.run_id <> (SELECT min(run_id) FROM n_ev) AS has_prod FROM n_ev n JOIN o_ev o ON n.run_id = o.run_id)""",
    f"""gf AS (SELECT *, list_filter([
           CASE WHEN has_prod AND coalesce(r2 - prod_r2, 0.0) < {C.IMPROVEMENT_THRESHOLD} THEN 'improvement' END,
           CASE WHEN accuracy < {C.DEPLOY_MIN_ACCURACY} THEN 'accuracy' END,
           CASE WHEN r2 < {C.DEPLOY_MIN_R2} THEN 'r2' END,
           CASE WHEN precision_macro < {C.DEPLOY_MIN_PRECISION} THEN 'precision' END], lambda x: x IS NOT NULL) AS failed_checks
         FROM gt)""",
    """gd AS (SELECT *, len(failed_checks) = 0 AS passed,
           CASE WHEN NOT has_prod THEN len(list_filter(failed_checks, lambda x: x <> 'improvement')) = 0
                ELSE len(failed_checks) = 0 END AS deploy FROM gf)"""]


@query("deploy_gate", V.with_("scored", extra=_GATE_CTES) + """
SELECT run_id, array_to_string(failed_checks, ',') AS failed_checks, passed FROM gd""")
def deploy_gate(spark, sf_dir):
    """Gate per run: improvement over production in the primary metric (r2), then minima."""
    g = _gated(spark, sf_dir)
    return g.select("run_id", F.array_join("failed_checks", ",").alias("failed_checks"), "passed")


@query("deploy_decision", V.with_("scored", extra=_GATE_CTES) + "SELECT run_id, deploy FROM gd")
def deploy_decision(spark, sf_dir):
    """force -> deploy; no production model yet -> deploy if minima pass; else the gate."""
    return _gated(spark, sf_dir).select("run_id", "deploy")


@query("registry_current", V.with_("scored", extra=_GATE_CTES) + """
SELECT arg_max('v' || run_id, CAST(run_id || '-01' AS DATE)) AS current_version,
       max(CAST(run_id || '-01' AS DATE)) AS deployment_date, count(*) AS n_deployments
FROM gd WHERE deploy""")
def registry_current(spark, sf_dir):
    """Append-only registry of deployments; current version = latest deployment."""
    g = _gated(spark, sf_dir).where(F.col("deploy"))
    reg = g.select(F.concat(F.lit("v"), F.col("run_id")).alias("model_version"),
                   F.to_date(F.concat(F.col("run_id"), F.lit("-01"))).alias("deployment_date"),
                   "run_id", F.lit("regression").alias("task"))
    path = scratch_path(spark, "registry")
    reg.write.mode("append").parquet(path)
    return GT.registry_current(spark.read.parquet(path))


_PREG_SQL = V.with_("scored", extra=eval_ctes(g=["run_id"])) + f"""
SELECT run_id, round(mse - lag(mse) OVER (ORDER BY run_id), {RD}) AS mse_increase, round(mae - lag(mae) OVER (ORDER BY run_id), {RD}) AS mae_increase,
       {SIG('r2', SD)} AS r2, coalesce(mse - lag(mse) OVER (ORDER BY run_id) > {C.MAX_MSE_INCREASE}, false)
           OR coalesce(mae - lag(mae) OVER (ORDER BY run_id) > {C.MAX_MAE_INCREASE}, false) OR r2 < {C.MIN_R2_MONITOR} AS degraded
FROM ev"""


@query("perf_regression", _PREG_SQL)
def perf_regression(spark, sf_dir):
    """Declared regression thresholds checked run over run: MSE/MAE increase vs previous run, minimum R²
    (the window runs over the per-run metric table: one row per run)."""
    s = _scored(spark, sf_dir)
    m = EV.regression_metrics(s, group_cols=["run_id"])
    w = Window.orderBy("run_id")
    mi = F.col("mse") - F.lag("mse").over(w)
    ai = F.col("mae") - F.lag("mae").over(w)
    deg = (F.coalesce(mi > C.MAX_MSE_INCREASE, F.lit(False)) | F.coalesce(ai > C.MAX_MAE_INCREASE, F.lit(False))
           | (F.col("r2") < C.MIN_R2_MONITOR))
    out = m.select("run_id", mi.alias("mse_increase"), ai.alias("mae_increase"), "r2", deg.alias("degraded"))
    return out.withColumns({"mse_increase": r("mse_increase", RD), "mae_increase": r("mae_increase", RD), "r2": sig("r2", SD)})
