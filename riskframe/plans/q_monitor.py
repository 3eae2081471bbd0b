"""Registered queries: reference statistics, drift, performance monitoring and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.expressions import band3, exact_avg
from ..operators import features as FE
from ..operators import monitor as MO
from ..operators import reference as RE
from ..sources import fixtures
from . import sql_views as V
from .common import SIG, XAVG, inputs, prep, scratch_path, sig
from .q_features import fitted
from .registry import ORACLES, query

REF_NUM = ["apr", "nPaidOff", "loanAmount", "leadCost"]
REF_BOOL = ["approved", "originated", "isFunded"]
REF_CAT = ["payFrequency", "state", "leadType", "loanStatus"]


def _ref_frame(spark, sf_dir):
    loan, _, _ = inputs(spark, sf_dir)
    return loan.select(*REF_NUM, *REF_BOOL, *REF_CAT)


def _num_long_sql(src: str, cols: list[str]) -> str:
    return f"(UNPIVOT (SELECT {', '.join(cols)} FROM {src}) ON {', '.join(cols)} INTO NAME feature VALUE value)"


_NUM_STATS_SQL = f"""SELECT feature, count(value) AS n, {XAVG('value')} AS mean, {SIG('stddev_samp(value)')} AS std,
       min(value) AS min, max(value) AS max, {SIG('quantile_cont(value, 0.5)', 12)} AS median,
       {SIG('quantile_cont(value, 0.1)', 12)} AS p10, {SIG('quantile_cont(value, 0.9)', 12)} AS p90"""


def _round_num_stats(df):
    return df.withColumns({"std": sig("std"), "median": sig("median", 12), "p10": sig("p10", 12),
                           "p90": sig("p90", 12)})


@query("ref_stats_num", V.with_("loan") + _NUM_STATS_SQL + f" FROM {_num_long_sql('loan', REF_NUM)} "
       "WHERE value IS NOT NULL GROUP BY feature")
def ref_stats_num(spark, sf_dir):
    """Numeric reference statistics (mean, std, min, max, median, p10, p90) of every numeric column:
    one unpivoted aggregate plus one distributed quantile job."""
    df = _ref_frame(spark, sf_dir)
    return _round_num_stats(MO.numeric_stats(df, REF_NUM)).select(
        "feature", "n", "mean", "std", "min", "max", "median", "p10", "p90")


@query("ref_stats_bool", V.with_("loan") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, {XAVG(f'CAST({c} AS INTEGER)')} AS mean FROM loan" for c in REF_BOOL))
def ref_stats_bool(spark, sf_dir):
    """Boolean reference statistics (share true); kept as a statistic, never compared for drift."""
    return MO.boolean_stats(_ref_frame(spark, sf_dir), REF_BOOL)


_CAT_SQL = f"""SELECT feature, category, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY feature) AS share,
       count(*) OVER (PARTITION BY feature) AS nunique FROM (
  SELECT feature, value AS category, count(*) AS n FROM {{src}} WHERE value IS NOT NULL GROUP BY ALL)"""


def _cat_long_sql(src: str, cols: list[str]) -> str:
    return (f"(UNPIVOT (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in cols)} FROM {src}) "
            f"ON {', '.join(cols)} INTO NAME feature VALUE value)")


@query("ref_stats_cat", V.with_("loan") + _CAT_SQL.format(src=_cat_long_sql("loan", REF_CAT)))
def ref_stats_cat(spark, sf_dir):
    """Categorical reference statistics: share per category and number of distinct categories."""
    return MO.category_shares(_ref_frame(spark, sf_dir), REF_CAT)


_REF_STATS_SQL = V.with_("loan", extra=[
    "ns AS (" + _NUM_STATS_SQL.replace(f"{SIG('stddev_samp(value)')} AS std", "stddev_samp(value) AS std")
    .replace(f"{SIG('quantile_cont(value, 0.5)', 12)}", "quantile_cont(value, 0.5)")
    .replace(f"{SIG('quantile_cont(value, 0.1)', 12)}", "quantile_cont(value, 0.1)")
    .replace(f"{SIG('quantile_cont(value, 0.9)', 12)}", "quantile_cont(value, 0.9)")
    + f" FROM {_num_long_sql('loan', REF_NUM)} WHERE value IS NOT NULL GROUP BY feature)",
    "cs AS (" + _CAT_SQL.format(src=_cat_long_sql("loan", REF_CAT)) + ")"]) + f"""
SELECT feature, kind, stat, {SIG('value')} AS value FROM (
  SELECT feature, 'numeric' AS kind, stat, value FROM (UNPIVOT (SELECT feature, mean, std, min, max, median, p10, p90 FROM ns)
      ON mean, std, min, max, median, p10, p90 INTO NAME stat VALUE value)
  UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', 'boolean', 'mean', {XAVG(f'CAST({c} AS INTEGER)')} FROM loan" for c in REF_BOOL) + """
  UNION ALL SELECT feature, 'categorical', category, share FROM cs
  UNION ALL SELECT DISTINCT feature, 'categorical', '__nunique', CAST(nunique AS DOUBLE) FROM cs)"""


@query("ref_stats", _REF_STATS_SQL)
def ref_stats(spark, sf_dir):
    """Reference-statistics sink: the tidy (feature, kind, stat, value) table appended under a run id
    and read back (latest run)."""
    from ..sources import io
    st = MO.reference_stats(_ref_frame(spark, sf_dir))
    path = scratch_path(spark, "reference-stats")
    io.write_run(st, path, "ref_run")
    return io.read_run(spark, path).select("feature", "kind", "stat", sig("value").alias("value"))


def _saved_runs(spark, sf_dir):
    """Two saved references: an older run of the new events, the last one of the reference events."""
    ref, new = _drift_inputs(spark, sf_dir)
    root = scratch_path(spark, "reference")
    RE.save_reference(new, root, "ref_20240101")
    RE.save_reference(ref, root, "ref_20240116")
    return root, new


@query("ref_rows_saved", V.with_("drift") + "SELECT event_type, value, count(*) AS n FROM ref GROUP BY ALL")
def ref_rows_saved(spark, sf_dir):
    """Reference-data sink: the rows of a run are saved beside its statistics; the last run's rows are read back."""
    root, _ = _saved_runs(spark, sf_dir)
    return RE.saved_rows(spark, root).groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))


def _feature_stat_cols():
    from .q_features import _VAR_FEATURES, _FULL_DROPPED
    return [c for c in _VAR_FEATURES if c not in _FULL_DROPPED]


@query("feature_statistics", V.with_("engineered") + f"""
SELECT feature, {SIG(XAVG('value'), 9)} AS mean, {SIG('stddev_samp(value)')} AS std, min(value) AS min, max(value) AS max
FROM {_num_long_sql('engineered', _feature_stat_cols())} GROUP BY feature""")
def feature_statistics(spark, sf_dir):
    """Mean, std, min, max of every numeric model feature of the fitted feature table."""
    base, pipe, spec = fitted(spark, sf_dir)
    df = pipe.transform(base, spec)
    cols = spec.numeric_features
    ns = MO.numeric_stats(df, cols)
    return ns.select("feature", sig("mean", 9).alias("mean"), sig("std").alias("std"), "min", "max")


# --------------------------------------------------------------------------------------------- drift

def _drift_inputs(spark, sf_dir):
    prep(spark)
    return fixtures.drift_frames(spark, sf_dir)


@query("drift_stats", V.with_("drift", extra=[
    f"r AS (SELECT {XAVG('value')} AS ref_mean, stddev_samp(value) AS ref_std FROM ref)",
    f"n AS (SELECT {XAVG('value')} AS new_mean, stddev_samp(value) AS new_std FROM new)"]) + f"""
SELECT 'value' AS feature, abs(new_mean - ref_mean) / greatest(abs(ref_mean), 1e-10) AS mean_diff,
       {SIG('abs(new_std - ref_std) / greatest(abs(ref_std), 1e-10)')} AS std_diff,
       abs(new_mean - ref_mean) / greatest(abs(ref_mean), 1e-10) > {C.DRIFT_THRESHOLD}
       OR abs(new_std - ref_std) / greatest(abs(ref_std), 1e-10) > {C.DRIFT_THRESHOLD} AS drifted
FROM r, n""")
def drift_stats(spark, sf_dir):
    """Numeric drift of new events against the saved reference statistics (relative mean/std change)."""
    ref, new = _drift_inputs(spark, sf_dir)
    st = MO.reference_stats(ref, quantiles=False)
    d = MO.drift_numeric(new, st)
    return d.withColumn("std_diff", sig("std_diff"))


@query("drift_categorical", V.with_("drift", extra=[
    "rs AS (SELECT event_type AS category, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS ref_share "
    "FROM ref WHERE event_type IS NOT NULL GROUP BY 1)",
    "ns AS (SELECT event_type AS category, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS new_share "
    "FROM new WHERE event_type IS NOT NULL GROUP BY 1)"]) + f"""
SELECT 'event_type' AS feature,
       coalesce(max(CASE WHEN ref_share IS NULL THEN (CASE WHEN new_share > {C.CATEGORICAL_DRIFT_THRESHOLD} THEN new_share END)
                     ELSE abs(new_share - ref_share) END), 0.0) AS max_category_diff,
       bool_or(CASE WHEN ref_share IS NULL THEN new_share > {C.CATEGORICAL_DRIFT_THRESHOLD}
                    ELSE abs(new_share - ref_share) > {C.CATEGORICAL_DRIFT_THRESHOLD} END) AS drifted
FROM ns LEFT JOIN rs USING (category)""")
def drift_categorical(spark, sf_dir):
    """Categorical drift: unseen categories over the threshold, or a known category's share shift."""
    ref, new = _drift_inputs(spark, sf_dir)
    st = MO.reference_stats(ref, quantiles=False)
    return MO.drift_categorical(new, st)


def _ks_sql(ref: str, new: str, col: str, feature: str) -> list[str]:
    return [
        f"ku AS (SELECT {col} AS v, 1 AS r, 0 AS m FROM {ref} WHERE {col} IS NOT NULL "
        f"UNION ALL SELECT {col}, 0, 1 FROM {new} WHERE {col} IS NOT NULL)",
        "kd AS (SELECT v, sum(r) AS r, sum(m) AS m FROM ku GROUP BY v)",
        "kt AS (SELECT sum(r) AS nr, sum(m) AS nm FROM kd)",
        "kc AS (SELECT v, sum(r) OVER (ORDER BY v) AS cr, sum(m) OVER (ORDER BY v) AS cm FROM kd)",
        f"""ks AS (SELECT '{feature}' AS feature, CAST(nr AS BIGINT) AS n_ref, CAST(nm AS BIGINT) AS n_new,
              max(abs(CAST(cr AS DOUBLE) / nr - CAST(cm AS DOUBLE) / nm)) AS ks_statistic FROM kc, kt GROUP BY nr, nm)""",
        """kp AS (SELECT *, ks_statistic * sqrt(CAST(n_ref AS DOUBLE) * n_new / (n_ref + n_new)) AS lam FROM ks)""",
    ]


_KS_SELECT = f"""SELECT feature, n_ref, n_new, ks_statistic,
       CASE WHEN lam < 0.3 THEN 1.0 ELSE {SIG('least(1.0, greatest(0.0, 2.0 * (SELECT sum(pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k))))', 8)} END AS p_value,
       ks_statistic > {C.KS_THRESHOLD} AS drifted FROM kp"""


@query("drift_ks", V.with_("drift", extra=_ks_sql("ref", "new", "value", "value")) + _KS_SELECT)
def drift_ks(spark, sf_dir):
    """Two-sample KS per numeric column via distributed running counts (tied values grouped first)."""
    ref, new = _drift_inputs(spark, sf_dir)
    ks = MO.drift_ks(new.select("value"), ref.select("value"))
    return ks.select("feature", "n_ref", "n_new", "ks_statistic", sig("p_value", 8).alias("p_value"), "drifted")


@query("drift_ks_saved", ORACLES["drift_ks"])
def drift_ks_saved(spark, sf_dir):
    """KS of the new events against the saved distributions of the last reference run; the reference rows are not read."""
    root, new = _saved_runs(spark, sf_dir)
    ks = RE.ks_saved(new.select("value"), root)
    return ks.select("feature", "n_ref", "n_new", "ks_statistic", sig("p_value", 8).alias("p_value"), "drifted")


@query("drift_report", V.with_("drift", extra=[
    f"r AS (SELECT {XAVG('value')} AS ref_mean, stddev_samp(value) AS ref_std FROM ref)",
    f"n AS (SELECT {XAVG('value')} AS new_mean, stddev_samp(value) AS new_std FROM new)",
    "rs AS (SELECT event_type AS category, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS ref_share "
    "FROM ref WHERE event_type IS NOT NULL GROUP BY 1)",
    "ns AS (SELECT event_type AS category, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS new_share "
    "FROM new WHERE event_type IS NOT NULL GROUP BY 1)"]) + f"""
SELECT 'value' AS feature, 'stats' AS method,
       {SIG('greatest(abs(new_mean - ref_mean) / greatest(abs(ref_mean), 1e-10), abs(new_std - ref_std) / greatest(abs(ref_std), 1e-10))')} AS score,
       abs(new_mean - ref_mean) / greatest(abs(ref_mean), 1e-10) > {C.DRIFT_THRESHOLD}
       OR abs(new_std - ref_std) / greatest(abs(ref_std), 1e-10) > {C.DRIFT_THRESHOLD} AS drifted FROM r, n
UNION ALL
SELECT 'event_type', 'categorical',
       {SIG(f"coalesce(max(CASE WHEN ref_share IS NULL THEN (CASE WHEN new_share > {C.CATEGORICAL_DRIFT_THRESHOLD} THEN new_share END) ELSE abs(new_share - ref_share) END), 0.0)")},
       bool_or(CASE WHEN ref_share IS NULL THEN new_share > {C.CATEGORICAL_DRIFT_THRESHOLD}
                    ELSE abs(new_share - ref_share) > {C.CATEGORICAL_DRIFT_THRESHOLD} END)
FROM ns LEFT JOIN rs USING (category)""")
def drift_report(spark, sf_dir):
    """Drift dispatch with saved statistics: numeric and categorical rows in one table."""
    ref, new = _drift_inputs(spark, sf_dir)
    rep = MO.drift_report(new, ref_stats=MO.reference_stats(ref, quantiles=False))
    return rep.withColumn("score", sig("score"))


_DRIFT_REPORT_SQL = ORACLES["drift_report"]


@query("drift_report_saved", _DRIFT_REPORT_SQL)
def drift_report_saved(spark, sf_dir):
    """Drift dispatch with neither data nor statistics at hand: the latest saved run of statistics is used (an
    older run, of the new data, lies beside it)."""
    from ..sources import io
    ref, new = _drift_inputs(spark, sf_dir)
    path = scratch_path(spark, "saved-stats")
    io.write_run(MO.reference_stats(new, quantiles=False), path, "ref_20240101")
    io.write_run(MO.reference_stats(ref, quantiles=False), path, "ref_20240116")
    rep = MO.drift_report(new, saved_stats=path)
    return rep.withColumn("score", sig("score"))


_DAILY_SQL = f"""WITH r AS (SELECT event_type, {XAVG('value')} AS ref_mean, stddev_samp(value) AS ref_std
                FROM events WHERE ts < TIMESTAMP '{fixtures.DRIFT_SPLIT_TS}' GROUP BY event_type),
d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, {XAVG('value')} AS mean,
             stddev_samp(value) AS std FROM events GROUP BY ALL)
SELECT day, event_type, n, mean, {SIG('std')} AS std,
       abs(mean - ref_mean) / greatest(abs(ref_mean), 1e-10) AS mean_diff,
       abs(mean - ref_mean) / greatest(abs(ref_mean), 1e-10) > {C.DRIFT_THRESHOLD}
       OR coalesce(abs(std - ref_std) / greatest(abs(ref_std), 1e-10) > {C.DRIFT_THRESHOLD}, false) AS drifted
FROM d JOIN r USING (event_type)"""


@query("drift_daily", _DAILY_SQL)
def drift_daily(spark, sf_dir):
    """Batch twin of the daily stream: per day and event type, stats and drift vs the reference window."""
    from ..streaming.daily import daily_drift
    prep(spark)
    ev = fixtures.table(spark, sf_dir, "events")
    return daily_drift(ev, spark)


_SPLIT_RUN = "1998-01"


def _band_sql(x: str) -> str:
    from .q_eval import _band
    return _band(x)


@query("drift_risk_band", V.with_("scored", extra=[
    f"""b AS (SELECT run_id < '{_SPLIT_RUN}' AS is_ref,
              CASE {' '.join(f"WHEN band = {k} THEN '{n}'" for k, n in [(0, 'low'), (1, 'medium'), (2, 'high')])} END AS band
              FROM (SELECT run_id, {_band_sql('y_pred')} AS band FROM scored))""",
    "rs AS (SELECT band AS category, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS ref_share FROM b WHERE is_ref GROUP BY 1)",
    "ns AS (SELECT band AS category, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS new_share FROM b WHERE NOT is_ref GROUP BY 1)"])
    + f"""
SELECT 'risk_band' AS feature,
       {SIG(f"coalesce(max(CASE WHEN ref_share IS NULL THEN (CASE WHEN new_share > {C.CATEGORICAL_DRIFT_THRESHOLD} THEN new_share END) ELSE abs(new_share - ref_share) END), 0.0)")} AS max_category_diff,
       bool_or(CASE WHEN ref_share IS NULL THEN new_share > {C.CATEGORICAL_DRIFT_THRESHOLD}
                    ELSE abs(new_share - ref_share) > {C.CATEGORICAL_DRIFT_THRESHOLD} END) AS drifted
FROM ns LEFT JOIN rs USING (category)""")
def drift_risk_band(spark, sf_dir):
    """Declared 'risk distribution shift' check: categorical drift of predicted risk bands, later runs
    against earlier runs."""
    prep(spark)
    s = fixtures.scored(spark, sf_dir)
    label = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), band3("y_pred") + 1)
    b = s.select((F.col("run_id") < _SPLIT_RUN).alias("is_ref"), label.alias("risk_band"))
    ref = b.where("is_ref").select("risk_band")
    new = b.where(~F.col("is_ref")).select("risk_band")
    d = MO.drift_categorical(new, MO.reference_stats(ref, quantiles=False))
    return d.withColumn("max_category_diff", sig("max_category_diff"))


# ---------------------------------------------------------------------------------------- performance

def _labelled(spark, sf_dir):
    prep(spark)
    s = fixtures.scored(spark, sf_dir)
    return s.select(F.col("score_date").alias("ts"), (F.col("y_pred") >= 0.5).cast("int").alias("prediction"),
                    (F.col("y_true") >= 0.5).cast("int").alias("actual"))


_PERF_CTES = [
    "lb AS (SELECT score_date AS ts, CAST(y_pred >= 0.5 AS INTEGER) AS prediction, CAST(y_true >= 0.5 AS INTEGER) AS actual FROM scored)",
    """pd AS (SELECT ts, CAST(count(*) FILTER (WHERE prediction = actual) AS DOUBLE) / count(*) AS accuracy,
              CAST(count(*) FILTER (WHERE prediction = 1 AND actual = 1) AS DOUBLE) / greatest(count(*) FILTER (WHERE prediction = 1), 1) AS precision,
              CAST(count(*) FILTER (WHERE prediction = 1 AND actual = 1) AS DOUBLE) / greatest(count(*) FILTER (WHERE actual = 1), 1) AS recall
            FROM lb GROUP BY ts)""",
    "pf AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-10) AS f1 FROM pd)",
    f"hist AS (SELECT * FROM pf ORDER BY ts DESC LIMIT {C.HISTORY_KEEP})",
    "base AS (SELECT arg_min(accuracy, ts) AS baseline_accuracy, arg_min(f1, ts) AS baseline_f1 FROM pf)",
]


def _history(spark, sf_dir):
    """(kept history, baseline): the table keeps every entry, the history view its last 100."""
    lab = _labelled(spark, sf_dir)
    daily = MO.binary_performance(lab, group_cols=["ts"])
    path = scratch_path(spark, "perf-history")
    daily.write.mode("append").parquet(path)  # history sink (append-only)
    full = spark.read.parquet(path)
    return MO.history_tail(full), MO.baseline(full)


@query("perf_history", V.with_("scored", extra=_PERF_CTES) + "SELECT ts, accuracy, precision, recall, f1 FROM hist")
def perf_history(spark, sf_dir):
    """Performance-history sink: one entry per scoring day appended; the last 100 entries kept."""
    return _history(spark, sf_dir)[0].select("ts", "accuracy", "precision", "recall", "f1")


@query("perf_check", V.with_("scored", extra=_PERF_CTES + [
    """cur AS (SELECT CAST(count(*) FILTER (WHERE prediction = actual) AS DOUBLE) / count(*) AS accuracy,
              CAST(count(*) FILTER (WHERE prediction = 1 AND actual = 1) AS DOUBLE) / greatest(count(*) FILTER (WHERE prediction = 1), 1) AS precision,
              CAST(count(*) FILTER (WHERE prediction = 1 AND actual = 1) AS DOUBLE) / greatest(count(*) FILTER (WHERE actual = 1), 1) AS recall
            FROM lb)""",
    "cf AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-10) AS f1 FROM cur)"]) + f"""
SELECT accuracy, precision, recall, f1, baseline_accuracy, baseline_f1,
       (accuracy - baseline_accuracy) / greatest(baseline_accuracy, 1e-10) AS rel_accuracy_change,
       (f1 - baseline_f1) / greatest(baseline_f1, 1e-10) AS rel_f1_change,
       accuracy < {C.MIN_ACCURACY_MONITOR} OR f1 < {C.MIN_F1_MONITOR}
       OR (accuracy - baseline_accuracy) / greatest(baseline_accuracy, 1e-10) < {C.RELATIVE_DEGRADATION_THRESHOLD}
       OR (f1 - baseline_f1) / greatest(baseline_f1, 1e-10) < {C.RELATIVE_DEGRADATION_THRESHOLD} AS degradation_detected
FROM cf, base""")
def perf_check(spark, sf_dir):
    """Current binary performance vs thresholds and vs the history baseline (the first entry ever)."""
    lab = _labelled(spark, sf_dir)
    cur = MO.binary_performance(lab)
    return MO.performance_check(cur, _history(spark, sf_dir)[1]).select(
        "accuracy", "precision", "recall", "f1", "baseline_accuracy", "baseline_f1", "rel_accuracy_change",
        "rel_f1_change", "degradation_detected")


@query("concept_drift", V.with_("scored", extra=_PERF_CTES[:1] + [
    "cd AS (SELECT ts, count(*) AS n, count(*) FILTER (WHERE prediction <> actual) AS errors FROM lb GROUP BY ts)",
    "cs AS (SELECT ts, n, errors, sum(n) OVER w AS cn, CAST(sum(errors) OVER w AS DOUBLE) / sum(n) OVER w AS p FROM cd WINDOW w AS (ORDER BY ts))",
    "cp AS (SELECT *, sqrt(p * (1 - p) / cn) AS s FROM cs)",
    f"cb AS (SELECT *, min(CASE WHEN cn >= {C.CONCEPT_LEAST} THEN {{'level': p + s, 'p': p, 's': s}} END) OVER (ORDER BY ts) AS best FROM cp)"]) + f"""
SELECT ts, n, errors, p AS error_rate, s AS error_std, best.p AS min_rate, best.s AS min_std,
       CASE WHEN best IS NULL THEN 'learning' WHEN p + s > best.p + {C.CONCEPT_DRIFT} * best.s THEN 'drift'
            WHEN p + s > best.p + {C.CONCEPT_WARNING} * best.s THEN 'warning' ELSE 'stable' END AS state FROM cb""")
def concept_drift(spark, sf_dir):
    """Declared 'concept drift' check: drift detection on the sequence of a model's daily errors."""
    return MO.concept_drift(_labelled(spark, sf_dir), "ts", F.col("prediction") != F.col("actual"))


@query("perf_trend", V.with_("scored", extra=_PERF_CTES) + "SELECT ts, accuracy, f1, baseline_accuracy, baseline_f1 FROM hist, base")
def perf_trend(spark, sf_dir):
    """Accuracy and F1 over the kept history next to their baselines."""
    from ..operators import ranking
    h, base = _history(spark, sf_dir)
    return ranking.join_small(h.select("ts", "accuracy", "f1"), base, [], 1)
