"""Registered queries: preprocessing, training, importances, scoring, bands, artefact-only features,
streaming jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.expressions import app_band, band3, display_normalize, serving_band
from ..operators import artefact as AR
from ..operators import features as FE
from ..operators import model as MD
from ..operators import score as SC
from ..operators import split as SP
from ..operators import stats as ST
from ..operators import ranking
from ..session import memo
from ..sources import fixtures
from ..streaming.daily import compare_daily, reference_by_type, stream_scores
from ..streaming.daily import stream_daily_stats as run_daily
from ..streaming.daily import stream_monitor as run_monitor
from ..streaming.daily import stream_performance as run_performance
from . import q_monitor  # noqa: F401  (its oracles are registered first)
from . import sql_views as V
from .common import SIG, XAVG, inputs, prep, scratch_path, sig
from .q_features import fitted
from .registry import ORACLES, query

SCALE_COLS = ["apr", "nPaidOff", "loanAmount", "leadCost"]


@query("prep_scale", V.with_("loan", extra=[
    "m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in SCALE_COLS) + " FROM loan)",
    "f AS (SELECT l.loanId, " + ", ".join(f"coalesce(l.{c}, m.{c}) AS {c}" for c in SCALE_COLS) + " FROM loan l, m)",
    "s AS (SELECT " + ", ".join(f"{XAVG(c)} AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALE_COLS)
    + " FROM f)"]) + "SELECT f.loanId, " + ", ".join(
        SIG(f"(f.{c} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END)", 9) + f" AS {c}_scaled"
        for c in SCALE_COLS) + " FROM f, s")
def prep_scale(spark, sf_dir):
    """Numeric preprocessing: exact median imputation, standardisation with the population std."""
    loan, _, _ = inputs(spark, sf_dir)
    params = MD.fit_scaler(loan, SCALE_COLS)
    out = MD.apply_scaler(loan, params, "_scaled")
    return out.select("loanId", *[sig(f"{c}_scaled", 9).alias(f"{c}_scaled") for c in SCALE_COLS])


@query("prep_index", V.with_("loan") + """
SELECT loanId, state, CAST(dense_rank() OVER (ORDER BY state) - 1 AS INTEGER) AS state_index FROM loan""")
def prep_index(spark, sf_dir):
    """Alphabetical string indexing (labels fitted once: one small distinct list per category column)."""
    from pyspark.ml.feature import StringIndexer
    loan, _, _ = inputs(spark, sf_dir)
    m = StringIndexer(inputCol="state", outputCol="idx", handleInvalid="keep", stringOrderType="alphabetAsc").fit(loan)
    return m.transform(loan).select("loanId", "state", F.col("idx").cast("int").alias("state_index"))


@query("prep_index_wide", V.with_("loan") + """
SELECT loanId, anon_ssn, CAST(dense_rank() OVER (ORDER BY anon_ssn) - 1 AS INTEGER) AS ssn_index FROM loan""")
def prep_index_wide(spark, sf_dir):
    """Index of a column of many values by a joined table; no label passes through the driver."""
    loan, _, _ = inputs(spark, sf_dir)
    return MD.index_wide(loan, "anon_ssn", "idx").transform(loan).select("loanId", "anon_ssn", F.col("idx").cast("int").alias("ssn_index"))


def _onehot_sql(col: str, src: str) -> str:
    """0/1 list over the sorted labels of a column."""
    return f"list_transform((SELECT list_sort(list(DISTINCT {col})) FROM {src}), lambda v: CASE WHEN v = {col} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@query("prep_onehot", V.with_("loan", extra=["f AS (SELECT loanId, leadType, coalesce(payFrequency, 'Unknown') AS payFrequency FROM loan)"]) + f"""
SELECT loanId, leadType, {_onehot_sql('leadType', 'f')} AS leadType_ohe, {_onehot_sql('payFrequency', 'f')} AS payFrequency_ohe FROM f""")
def prep_onehot(spark, sf_dir):
    """One-hot vectors (dropLast); an unseen category maps to the all-zero vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    loan, _, _ = inputs(spark, sf_dir)
    df = loan.select("loanId", "leadType", "payFrequency").na.fill("Unknown", ["payFrequency"])
    stages, _ = MD.preprocessing_stages([], ["leadType", "payFrequency"])
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.select("loanId", "leadType", vector_to_array("leadType__ohe").alias("leadType_ohe"),
                      vector_to_array("payFrequency__ohe").alias("payFrequency_ohe"))


ASSEMBLE_NUM = ["loanAmount", "apr", "paymentAmount_sum", "loanAmount_squared"]


@query("prep_assemble", V.with_("engineered") + f"""
SELECT loanId, 4 + len((SELECT list(DISTINCT leadType) FROM engineered)) AS n_slots,
       list_concat([{", ".join(f"CAST({c} AS DOUBLE)" for c in ASSEMBLE_NUM)}], {_onehot_sql('leadType', 'engineered')}) AS features FROM engineered""")
def prep_assemble(spark, sf_dir):
    """Assembled feature vectors: numeric features, then the one-hot slots of a category."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    base, _, spec = fitted(spark, sf_dir)
    df = FE.add_squares(FE.add_interactions(FE.fill_missing(base, spec), spec), spec)
    stages, cols = MD.preprocessing_stages(ASSEMBLE_NUM, ["leadType"])
    out = Pipeline(stages=[*stages, VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")]).fit(df).transform(df)
    arr = vector_to_array("features")
    return out.select("loanId", F.size(arr).cast("long").alias("n_slots"), arr.alias("features"))


def _train_frame(spark, sf_dir):
    base, pipe, spec = fitted(spark, sf_dir)
    return SP.hash_split(pipe.transform(base, spec), "loanId", C.TEST_SIZE), pipe, spec


def train(spark, sf_dir):
    """Fit the configured model on the training split and publish it; returns the artefact's root folder."""
    df, pipe, spec = _train_frame(spark, sf_dir)
    rows = df.where(F.col("split") == "train")
    model, task = MD.fit_model(rows, spec.numeric_features, spec.categorical_features, "target", None, MD.mllib_params())
    root = scratch_path(spark, "models")
    AR.publish(spark, root, "v1", "run_1", pipe, spec, model, task, MD.importances(model, df), rows.count())
    return root


def artefact(spark, sf_dir):
    """The published artefact of this input, loaded from storage; trained first if this session has none."""
    store = memo(spark)
    if ("artefact", sf_dir) not in store:
        store["artefact", sf_dir] = train(spark, sf_dir)
    return AR.load(spark, store["artefact", sf_dir])


def _test_rows(spark, sf_dir, art):
    loan, clarity, payment = inputs(spark, sf_dir)
    df = SP.hash_split(art.features(FE.base_frame(loan, clarity, payment)), "loanId", C.TEST_SIZE)
    return df.where(F.col("split") == "test")


_TEST_SQL = "FROM loan WHERE ('0x' || substr(md5(loanId), 1, 8))::BIGINT % 5 = 0"


@query("model_train")
def model_train(spark, sf_dir):
    """Boosted-tree regression of the risk target with the configured rounds; predictions on the held-out split."""
    memo(spark)["artefact", sf_dir] = train(spark, sf_dir)  # trained on every call
    art = artefact(spark, sf_dir)
    return art.model.transform(_test_rows(spark, sf_dir, art)).select("loanId", "target", "prediction")


@query("model_publish", V.with_("loan") + """
SELECT 'v' || v AS model_version, 'regression' AS task, (SELECT count(*) FROM loan WHERE ('0x' || substr(md5(loanId), 1, 8))::BIGINT % 5 <> 0) AS n_rows,
       v = 2 AS is_current, true AS loads FROM range(1, 3) t(v)""")
def model_publish(spark, sf_dir):
    """Versioned publish: a second version of the artefact beside the first, both loadable, the registry's last is current."""
    art = artefact(spark, sf_dir)
    first = AR.registry(spark, memo(spark)["artefact", sf_dir])
    n = first.first()["n_rows"]
    root = scratch_path(spark, "publish")
    for version in ("v1", "v2"):
        AR.publish(spark, root, version, f"run_{version}", art.pipeline, art.spec, art.model, art.task, art.importances, n)
    current = AR.load(spark, root).version
    loads = {v: AR.load(spark, root, v).spec == art.spec for v in ("v1", "v2")}
    ok = F.create_map(*[F.lit(x) for kv in loads.items() for x in kv])
    return AR.registry(spark, root).select("model_version", "task", "n_rows", (F.col("model_version") == current).alias("is_current"),
                                           F.element_at(ok, F.col("model_version")).alias("loads"))


@query("model_importance")
def model_importance(spark, sf_dir):
    """Feature importances with names, largest first, top 20."""
    return ST.topk_by(artefact(spark, sf_dir).importances, "importance", 20)


@query("fe_select_topk")
def fe_select_topk(spark, sf_dir):
    """Select features by importance (at most 100 slots, one-hot slots count for their category), keeping key and target."""
    art = artefact(spark, sf_dir)
    df, _, _ = _train_frame(spark, sf_dir)
    imp = art.importances.where(F.col("importance") > 0).orderBy(F.desc("importance"), "feature").limit(100)
    names = [MD.source_column(r["feature"], df.columns) for r in imp.collect()]  # <= 100 names
    return df.select("loanId", *dict.fromkeys(n for n in names if n), "target")


@query("score_batch")
def score_batch(spark, sf_dir):
    """Batch scoring of the held-out split with the loaded artefact: value + serving band + app band."""
    art = artefact(spark, sf_dir)
    return SC.score(art.model, _test_rows(spark, sf_dir, art)).select("loanId", "prediction", "risk_category", "risk_level")


@query("score_batch_check", V.with_("loan") + f"SELECT loanId, true AS bands_agree, true AS in_range {_TEST_SQL}")
def score_batch_check(spark, sf_dir):
    """Every held-out loan is scored once, its bands follow from its prediction, and the prediction lies in the target's range."""
    p = F.col("prediction")
    agree = (F.col("risk_category") == F.when(p > 0.7, "high_risk").when(p > 0.3, "medium_risk").otherwise("low_risk")) \
        & (F.col("risk_level") == F.when(p <= 0.4, "Low Risk").when(p >= 0.6, "High Risk").otherwise("Medium Risk"))
    return score_batch(spark, sf_dir).select("loanId", agree.alias("bands_agree"), p.between(-0.5, 1.5).alias("in_range"))


@query("score_decision")
def score_decision(spark, sf_dir):
    """Classifier path: P(originated) >= threshold decision with a binary model (indexed label, configured rounds)."""
    df, _, spec = _train_frame(spark, sf_dir)
    df = df.withColumn("label", F.col("originated").cast("int"))
    num = [c for c in spec.numeric_features if not c.startswith("payFrequency")]
    model, _ = MD.fit_model(df.where(F.col("split") == "train"), num, spec.categorical_features, "label", None, MD.mllib_params())
    return SC.score(model, df.where(F.col("split") == "test")).select("loanId", "p1", "decision")


def _forms(spark, sf_dir):
    """Entry forms derived from the loans: the form's labels and an entered fraud score by key arithmetic."""
    loan, _, _ = inputs(spark, sf_dir)
    code = F.col("payFrequency")
    label = F.when(code == "W", "Weekly").when(code == "B", "Biweekly").when(code == "S", "Semimonthly").when(code == "M", "Monthly").otherwise("Yearly")
    number = F.substring("loanId", 2, 20).cast("long")
    return loan.select(F.concat(F.lit("PRED_"), "loanId").alias("loanId"), F.coalesce("loanAmount", F.lit(0.0)).alias("loan_amount"),
                       F.coalesce("apr", F.lit(0.0)).alias("apr"), label.alias("pay_frequency"), "state", F.col("leadType").alias("lead_type"),
                       F.coalesce("nPaidOff", F.lit(0.0)).alias("n_paid_off"), F.coalesce("leadCost", F.lit(0.0)).alias("lead_cost"),
                       (number % 850 + 100).alias("clear_fraud_score"), "applicationDate")


_FORM_SQL = V.with_("loan", extra=["""form AS (SELECT 'PRED_' || loanId AS loanId, coalesce(loanAmount, 0.0) AS loan_amount,
    CAST(substr(loanId, 2) AS BIGINT) % 850 + 100 AS clear_fraud_score, payFrequency FROM loan)"""])


@query("score_form_clarity", _FORM_SQL + """
SELECT DISTINCT 'CF_' || clear_fraud_score AS underwritingid, CAST(clear_fraud_score AS DOUBLE) AS clearfraudscore FROM form""")
def score_form_clarity(spark, sf_dir):
    """Fraud-score rows of entry forms: the entered score itself."""
    return SC.form_clarity(_forms(spark, sf_dir))


@query("score_form_payment", _FORM_SQL + """
SELECT loanId, 1 AS installmentIndex, loan_amount / 12 AS paymentAmount, 'Checked' AS paymentStatus, loan_amount / 15 AS principal,
       loan_amount / 60 AS fees FROM form""")
def score_form_payment(spark, sf_dir):
    """One successful installment per entry form."""
    return SC.form_payment(_forms(spark, sf_dir))


@query("score_form_request", _FORM_SQL + """
SELECT loanId, coalesce(CASE WHEN payFrequency IN ('W', 'B', 'S', 'M') THEN payFrequency END, 'W') AS payFrequency,
       'CF_' || clear_fraud_score AS clarityFraudId, 'New Loan' AS loanStatus, 'None' AS fpStatus, CAST(clear_fraud_score AS DOUBLE) AS clearfraudscore,
       1.0::DOUBLE AS payment_success_rate FROM form""")
def score_form_request(spark, sf_dir):
    """Entry forms as requests, joined with their own clarity and payment rows."""
    forms = _forms(spark, sf_dir)
    base = FE.base_frame(SC.form_requests(forms), SC.form_clarity(forms), SC.form_payment(forms))
    return base.select("loanId", "payFrequency", "clarityFraudId", "loanStatus", "fpStatus", "clearfraudscore", "payment_success_rate")


@query("score_request")
def score_request(spark, sf_dir):
    """Request scoring: entry forms -> requests with their own clarity and payment rows -> the artefact's features and
    model -> app band."""
    art = artefact(spark, sf_dir)
    forms = _forms(spark, sf_dir)
    req = SC.input_defaults(SC.form_requests(forms), clarity_present=True)
    base = FE.base_frame(req, SC.form_clarity(forms), SC.form_payment(forms))
    feats = SC.output_defaults(art.features(base))
    return SC.score(art.model, feats).select("loanId", "prediction", "risk_level")


def _streamed(spark, sf_dir, art):
    src = scratch_path(spark, "score-stream-in")
    _test_rows(spark, sf_dir, art).write.mode("overwrite").parquet(src)
    return stream_scores(spark, src, scratch_path(spark, "score-stream-ckpt"), scratch_path(spark, "score-stream-out"),
                         lambda df: SC.score(art.model, df, art.task).select("loanId", "prediction", "risk_category"))


@query("score_stream")
def score_stream(spark, sf_dir):
    """Stream scoring: the artefact applied to a stream of feature rows (file source, table sink, availableNow)."""
    return _streamed(spark, sf_dir, artefact(spark, sf_dir))


@query("score_stream_check", V.with_("loan") + f"SELECT loanId, true AS equal {_TEST_SQL}")
def score_stream_check(spark, sf_dir):
    """The stream's scores equal the batch's, row for row."""
    art = artefact(spark, sf_dir)
    s = _streamed(spark, sf_dir, art)
    b = SC.score(art.model, _test_rows(spark, sf_dir, art)).select("loanId", F.col("prediction").alias("p"), F.col("risk_category").alias("c"))
    return s.join(b, "loanId", "full").select("loanId", F.coalesce((F.abs(F.col("prediction") - F.col("p")) < 1e-12) & (F.col("risk_category") == F.col("c")),
                                                                   F.lit(False)).alias("equal"))


def _in_time_order(df, col: str, path: str, cuts: list) -> None:
    """Files that arrive in event-time order: one time range after the other is appended."""
    for lo, hi in zip(cuts, cuts[1:]):
        df.where((F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(hi))).coalesce(1).write.mode("append").parquet(path)


@query("stream_daily_stats", ORACLES["drift_daily"])
def stream_daily_stats(spark, sf_dir):
    """Daily drift statistics as a Structured Streaming job (mergeable moments per micro-batch, table sink), compared with the
    reference window; equals the batch twin although every file holds events of all days."""
    prep(spark)
    events = fixtures.table(spark, sf_dir, "events")
    path = scratch_path(spark, "events-stream-in")
    events.repartition(6, F.xxhash64("ts", "value")).write.parquet(path)
    daily = run_daily(spark, path, scratch_path(spark, "daily-stream-ckpt"), scratch_path(spark, "daily-stream-out"))
    return compare_daily(daily, reference_by_type(events)).withColumn("std", sig("std"))


_YEARLY = [
    "lb AS (SELECT year(score_date) AS y, score_date AS ts, CAST(y_pred >= 0.5 AS INTEGER) AS prediction, CAST(y_true >= 0.5 AS INTEGER) AS actual FROM scored)",
    """pd AS (SELECT y, min(ts) AS ts, count(*) AS n, CAST(count(*) FILTER (WHERE prediction = actual) AS DOUBLE) / count(*) AS accuracy,
              CAST(count(*) FILTER (WHERE prediction = 1 AND actual = 1) AS DOUBLE) / greatest(count(*) FILTER (WHERE prediction = 1), 1) AS precision,
              CAST(count(*) FILTER (WHERE prediction = 1 AND actual = 1) AS DOUBLE) / greatest(count(*) FILTER (WHERE actual = 1), 1) AS recall
            FROM lb GROUP BY y)"""]


def _yearly_history(spark, sf_dir) -> str:
    """The history table of a stream of labelled predictions, one year a micro-batch."""
    prep(spark)
    s = fixtures.scored(spark, sf_dir)
    lab = s.select(F.col("score_date").alias("ts"), (F.col("y_pred") >= 0.5).cast("int").alias("prediction"), (F.col("y_true") >= 0.5).cast("int").alias("actual"))
    lo, hi = lab.agg(F.min(F.year("ts")), F.max(F.year("ts"))).first()
    path = scratch_path(spark, "labelled-stream-in")
    _in_time_order(lab, "ts", path, [date(y, 1, 1) for y in range(lo, hi + 2)])
    history = scratch_path(spark, "perf-stream-out")
    run_performance(spark, path, scratch_path(spark, "perf-stream-ckpt"), history)
    return history


@query("stream_performance", V.with_("scored", extra=_YEARLY) + """
SELECT ts, n, accuracy, precision, recall, 2 * precision * recall / greatest(precision + recall, 1e-10) AS f1 FROM pd""")
def stream_performance(spark, sf_dir):
    """Performance metrics appended per micro-batch (foreachBatch); one batch holds one year of labelled predictions."""
    return spark.read.parquet(_yearly_history(spark, sf_dir)).select("ts", "n", "accuracy", "precision", "recall", "f1")


@query("stream_monitor", V.with_("scored", extra=_YEARLY + [
    "pf AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-10) AS f1 FROM pd)",
    """pb AS (SELECT ts, accuracy, f1, first_value(accuracy) OVER w AS baseline_accuracy, first_value(f1) OVER w AS baseline_f1, count(*) OVER w AS entries
              FROM pf WINDOW w AS (ORDER BY y))""",
    """pr AS (SELECT *, (accuracy - baseline_accuracy) / greatest(baseline_accuracy, 1e-10) AS rel_accuracy_change,
                     (f1 - baseline_f1) / greatest(baseline_f1, 1e-10) AS rel_f1_change FROM pb)"""]) + f"""
SELECT ts, accuracy, f1, baseline_accuracy, baseline_f1, rel_accuracy_change, rel_f1_change, entries,
       accuracy < {C.MIN_ACCURACY_MONITOR} OR f1 < {C.MIN_F1_MONITOR} OR rel_accuracy_change < {C.RELATIVE_DEGRADATION_THRESHOLD}
       OR rel_f1_change < {C.RELATIVE_DEGRADATION_THRESHOLD} AS degradation_detected FROM pr""")
def stream_monitor(spark, sf_dir):
    """Stateful performance check after every batch of the stream: first entry ever as baseline, degradation flag per entry."""
    out = run_monitor(spark, _yearly_history(spark, sf_dir), scratch_path(spark, "monitor-ckpt"), scratch_path(spark, "monitor-out"))
    return out.select("ts", "accuracy", "f1", "baseline_accuracy", "baseline_f1", "rel_accuracy_change", "rel_f1_change", "entries", "degradation_detected")


# ------------------------------------------------------------------------------------------ bands

def _band_case(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {C.EVAL_LOW_MAX} THEN 0 WHEN {x} > {C.EVAL_HIGH_MIN} THEN 2 ELSE 1 END"


@query("risk_band", V.with_("scored") + f"SELECT loanId, y_pred, {_band_case('y_pred')} AS band FROM scored")
def risk_band(spark, sf_dir):
    """Evaluation bands: <= 0.3 low (0), (0.3, 0.7] medium (1), > 0.7 high (2)."""
    prep(spark)
    s = fixtures.scored(spark, sf_dir)
    return s.select("loanId", "y_pred", band3("y_pred").alias("band"))


@query("score_band", V.with_("scored") + f"""
SELECT loanId, y_pred, CASE WHEN y_pred > {C.EVAL_HIGH_MIN} THEN 'high_risk' WHEN y_pred > {C.EVAL_LOW_MAX}
       THEN 'medium_risk' ELSE 'low_risk' END AS risk_category FROM scored""")
def score_band(spark, sf_dir):
    prep(spark)
    s = fixtures.scored(spark, sf_dir)
    return s.select("loanId", "y_pred", serving_band("y_pred").alias("risk_category"))


@query("score_band_app", V.with_("scored") + f"""
SELECT loanId, y_pred, CASE WHEN y_pred <= {C.APP_LOW_MAX} THEN 'Low Risk' WHEN y_pred >= {C.APP_HIGH_MIN}
       THEN 'High Risk' ELSE 'Medium Risk' END AS risk_level FROM scored""")
def score_band_app(spark, sf_dir):
    """Single-request page bands: <= 0.4 low, >= 0.6 high (inclusive), else medium."""
    prep(spark)
    s = fixtures.scored(spark, sf_dir)
    return s.select("loanId", "y_pred", app_band("y_pred").alias("risk_level"))


@query("score_normalize", V.with_("scored") + f"""
SELECT loanId, y_pred * 7 - 1.5 AS raw_score,
       least(1.0, greatest(0.0, ((y_pred * 7 - 1.5) - ({C.DISPLAY_MIN})) / {C.DISPLAY_MAX - C.DISPLAY_MIN})) AS display_score
FROM scored""")
def score_normalize(spark, sf_dir):
    """Display normalisation of raw scores from the range -1..5 to [0, 1], clamped."""
    prep(spark)
    s = fixtures.scored(spark, sf_dir).select("loanId", (F.col("y_pred") * 7 - 1.5).alias("raw_score"))
    return s.select("loanId", "raw_score", display_normalize("raw_score").alias("display_score"))


@query("score_defaults", V.with_("loan", extra=[V.DATED.replace("FROM with_pay", "FROM loan")]) + f"""
SELECT loanId, false AS hasCF, anon_ssn, isFunded, loanAmount / 12 AS originallyScheduledPaymentAmount,
       days_to_origination, CAST({C.SYNTHETIC_FRAUD_SCORE} AS DOUBLE) AS clearfraudscore,
       CAST({C.SYNTHETIC_FRAUD_SCORE} AS DOUBLE) * {C.SYNTHETIC_FRAUD_SCORE} AS clearfraudscore_squared,
       CAST(0.0 AS DOUBLE) AS paymentAmount_mean, CAST(0.0 AS DOUBLE) AS principal_mean, CAST(0.0 AS DOUBLE) AS fees_mean,
       0 AS paymentAmount_sum, 0 AS principal_sum, 0 AS fees_sum, 0 AS paymentAmount_count,
       CAST(1.0 AS DOUBLE) AS payment_success_rate, 'None' AS fpStatus
FROM dated""")
def score_defaults(spark, sf_dir):
    """Scoring-time defaults: missing input columns, then all twelve expected outputs absent after processing
    (requests without clarity or payment data; the fraud score stands on the request itself)."""
    loan, _, _ = inputs(spark, sf_dir)
    req = SC.input_defaults(loan, clarity_present=False).withColumn("clearfraudscore", F.lit(float(C.SYNTHETIC_FRAUD_SCORE)))
    out = SC.output_defaults(FE.add_date_features(req.drop("clearfraudscore")), req)
    doubles = ["paymentAmount_mean", "principal_mean", "fees_mean", "payment_success_rate"]
    return out.select("loanId", "hasCF", "anon_ssn", "isFunded", "originallyScheduledPaymentAmount", "days_to_origination", "clearfraudscore",
                      "clearfraudscore_squared", *[F.col(c).cast("double").alias(c) for c in doubles],
                      "paymentAmount_sum", "principal_sum", "fees_sum", "paymentAmount_count", "fpStatus")


@query("score_synth_clarity", V.with_("loan") + f"""
SELECT DISTINCT clarityFraudId AS underwritingid, CAST({C.SYNTHETIC_FRAUD_SCORE} AS DOUBLE) AS clearfraudscore FROM loan""")
def score_synth_clarity(spark, sf_dir):
    """Synthetic fraud scores (300) for the distinct fraud ids of requests without clarity data."""
    loan, _, _ = inputs(spark, sf_dir)
    return SC.synthetic_clarity(loan)


@query("score_synth_payment", V.with_("loan") + """
SELECT loanId, 1 AS installmentIndex, loanAmount / 12 AS paymentAmount, 'Late' AS paymentStatus,
       loanAmount / 15 AS principal, loanAmount / 30 AS fees FROM loan""")
def score_synth_payment(spark, sf_dir):
    """One synthetic installment per request loan."""
    loan, _, _ = inputs(spark, sf_dir)
    return SC.synthetic_payment(loan)


# ----------------------------------------------------------------------------- artefact-only features

_WIN_COLS = ["loanAmount", "apr", "leadCost"]


@query("fe_winsorize", V.with_("loan", extra=[
    "q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.995) AS {c}" for c in _WIN_COLS) + " FROM loan)"])
    + "SELECT l.loanId, " + ", ".join(SIG(f"least(l.{c}, q.{c})", 12) + f" AS {c}" for c in _WIN_COLS)
    + " FROM loan l, q")
def fe_winsorize(spark, sf_dir):
    """Cap numeric features at their exact 0.995 quantile (fitted once, applied as a projection)."""
    loan, _, _ = inputs(spark, sf_dir)
    long = ST.unpivot_numeric(loan, _WIN_COLS)
    caps = {k[0]: q for (k, _), q in ranking.quantiles_of(long, ["feature"], "value", [0.995]).items()}
    return loan.select("loanId", *[sig(F.least(F.col(c), F.lit(caps[c])), 12).alias(c) for c in _WIN_COLS])


_CORR_DROP_COLS = ["loanAmount", "loanAmount_squared", "loanAmount_x_apr", "apr", "apr_squared", "clearfraudscore",
                   "clearfraudscore_squared", "paymentAmount_sum", "principal_sum", "fees_sum", "paymentAmount_count"]


@query("fe_drop_corr", V.with_("engineered", extra=[
    "c AS (SELECT " + ", ".join(f"corr({a}, {b}) AS c_{i}_{j}" for i, a in enumerate(_CORR_DROP_COLS)
                                for j, b in enumerate(_CORR_DROP_COLS) if i < j) + " FROM engineered)"])
    + " UNION ALL ".join(
        f"SELECT '{b}' AS feature, " + (" OR ".join(f"abs(c_{i}_{j}) > 0.95" for i in range(j)) if j else "false")
        + " AS dropped FROM c" for j, b in enumerate(_CORR_DROP_COLS)))
def fe_drop_corr(spark, sf_dir):
    """Drop a feature when its |Pearson correlation| with an earlier feature exceeds 0.95 (upper-triangle
    rule over one aggregate of all pairwise correlations)."""
    base, _, spec = fitted(spark, sf_dir)
    df = FE.add_squares(FE.add_interactions(FE.fill_missing(base, spec), spec), spec)
    cm = ST.corr_matrix(df, _CORR_DROP_COLS)
    pos = {c: i for i, c in enumerate(_CORR_DROP_COLS)}
    idx = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    upper = cm.where(F.element_at(idx, F.col("f1")) < F.element_at(idx, F.col("f2")))
    flags = upper.groupBy(F.col("f2").alias("feature")).agg(F.max(F.abs(F.col("corr")) > 0.95).alias("dropped"))
    first = spark.createDataFrame([(_CORR_DROP_COLS[0], False)], "feature string, dropped boolean")
    return flags.unionByName(first)


_GUARD_CANDIDATES = ["loanId", "anon_ssn", "clarityFraudId", "underwritingid", "loanStatus", "originated", "state",
                     "leadType", "payFrequency", "approved", "isFunded"]


@query("fe_leakage_guard", V.with_("engineered") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {str(c in C.LEAKAGE_EXCLUDE).lower()} AS excluded, count({c}) AS non_null "
    "FROM engineered" for c in _GUARD_CANDIDATES))
def fe_leakage_guard(spark, sf_dir):
    """Leakage guard: ids, join keys and the target's source columns present in the feature table are
    excluded from model inputs (with their non-null counts, one aggregate)."""
    base, pipe, spec = fitted(spark, sf_dir)
    df = pipe.transform(base, spec)
    cand = [c for c in _GUARD_CANDIDATES if c in df.columns]
    assert not set(spec.categorical_features) & set(C.LEAKAGE_EXCLUDE)
    row = df.agg(*[F.count(c).alias(c) for c in cand])
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(c in C.LEAKAGE_EXCLUDE).alias("excluded"),
                      F.col(c).alias("non_null")) for c in cand]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
