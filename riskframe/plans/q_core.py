"""Registered queries: sources, sinks, filters, joins, payment aggregates, target."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.expressions import exact_avg, exact_sum, status_risk
from ..operators import joins
from ..operators.features import add_date_features
from ..sources import fixtures, io, schemas
from . import sql_views as V
from .common import SIG, XAVG, XSUM, inputs, prep, r, scratch_path, sig
from .registry import query

LOAN_COLS = [f.name for f in schemas.LOAN.fields]
PAY_COLS = [f.name for f in schemas.PAYMENT.fields]

# ------------------------------------------------------------------------------------------- flagship

RISK_BY_STATE_SQL = V.with_("with_pay") + """
SELECT state,
       count(*) AS n_loans,
       {avg_target} AS avg_target,
       {avg_rate} AS avg_success_rate,
       {avg_score} AS avg_fraud_score,
       {total} AS total_paid
FROM with_pay GROUP BY state
""".format(avg_target=XAVG("CASE loanStatus " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.STATUS_RISK.items())
                           + f" ELSE {C.DEFAULT_RISK} END"),
           avg_rate=SIG(XAVG("payment_success_rate"), 9), avg_score=SIG(XAVG("clearfraudscore"), 9), total=SIG(XSUM("paymentAmount_sum"), 12))


@query("risk_by_state", RISK_BY_STATE_SQL)
def risk_by_state(spark, sf_dir):
    """Minimum slice: approved loans ⋈ fraud score ⋈ payment aggregates, risk target, per-state summary."""
    loan, clarity, payment = inputs(spark, sf_dir)
    df = joins.join_payments(joins.join_fraud(loan, clarity), payment)
    return (df.withColumn("target", status_risk("loanStatus"))
              .groupBy("state")
              .agg(F.count(F.lit(1)).alias("n_loans"),
                   exact_avg("target").alias("avg_target"),
                   exact_avg("payment_success_rate").alias("avg_success_rate"),
                   exact_avg("clearfraudscore").alias("avg_fraud_score"),
                   exact_sum("paymentAmount_sum").alias("total_paid"))
              .withColumns({"avg_success_rate": sig("avg_success_rate", 9), "avg_fraud_score": sig("avg_fraud_score", 9),
                            "total_paid": sig("total_paid", 12)}))


# -------------------------------------------------------------------------------------------- sources

@query("src_csv", V.with_("loan_all") + "SELECT * FROM loan_all")
def src_csv(spark, sf_dir):
    """CSV source with an explicit schema: the loan view is written as CSV and read back."""
    prep(spark)
    path = scratch_path(spark, "loan-csv")
    fixtures.loan(spark, sf_dir).write.mode("overwrite").option("header", "true").csv(path + "/loan.csv")
    return io.read_table(spark, path + "/loan.csv", schemas.LOAN)


@query("src_parquet", V.with_("payment") + "SELECT * FROM payment")
def src_parquet(spark, sf_dir):
    """Parquet source chosen by suffix: the payment view as Parquet, read back with the declared schema."""
    prep(spark)
    path = scratch_path(spark, "payment-pq") + "/payment.parquet"
    fixtures.payment(spark, sf_dir).write.mode("overwrite").parquet(path)
    return io.read_table(spark, path, schemas.PAYMENT)


@query("src_loan", V.with_("loan") + "SELECT * FROM loan")
def src_loan(spark, sf_dir):
    """Required loan source with the ingest filter (approved only)."""
    loan, _, _ = inputs(spark, sf_dir)
    return loan


@query("src_clarity", V.with_("clarity") + "SELECT * FROM clarity")
def src_clarity(spark, sf_dir):
    _, clarity, _ = inputs(spark, sf_dir)
    return clarity


@query("src_payment", V.with_("payment") + "SELECT loanId, count(*) AS n_rows, count(paymentAmount) AS n_amount, "
       "count(paymentStatus) AS n_status FROM payment GROUP BY loanId")
def src_payment(spark, sf_dir):
    """Optional payment source; when absent an empty frame of the 4+2 declared columns is returned."""
    prep(spark)
    path = scratch_path(spark, "payment-opt") + "/payment.parquet"
    fixtures.payment(spark, sf_dir).write.mode("overwrite").parquet(path)
    pay = io.optional_table(spark, path, schemas.PAYMENT)
    return pay.groupBy("loanId").agg(F.count(F.lit(1)).alias("n_rows"), F.count("paymentAmount").alias("n_amount"),
                                     F.count("paymentStatus").alias("n_status"))


@query("src_optional_empty", V.with_("loan") + """
SELECT state, count(*) AS n_loans, count(clarityFraudId) AS n_with_id FROM loan GROUP BY state""")
def src_optional_empty(spark, sf_dir):
    """Absent optional sources: empty clarity/payment frames, joins skipped, loans unchanged."""
    loan, _, _ = inputs(spark, sf_dir)
    missing = scratch_path(spark, "absent") + "/clarity.csv"
    clarity = io.optional_table(spark, missing, schemas.CLARITY)
    payment = io.optional_table(spark, missing.replace("clarity", "payment"), schemas.PAYMENT)
    df = joins.join_payments(joins.join_fraud(loan, clarity), payment)
    assert "clearfraudscore" not in df.columns and "paymentAmount_sum" not in df.columns
    return df.groupBy("state").agg(F.count(F.lit(1)).alias("n_loans"), F.count("clarityFraudId").alias("n_with_id"))


@query("src_latest_run", V.with_("scored") + """
SELECT loanId, y_true, y_pred, run_id FROM scored WHERE run_id = (SELECT max(run_id) FROM scored)""")
def src_latest_run(spark, sf_dir):
    """Run-partitioned table; the lexicographically last run is chosen from the partition folders, only its files are read."""
    prep(spark)
    path = scratch_path(spark, "runs")
    fixtures.scored(spark, sf_dir).select("loanId", "y_true", "y_pred", "run_id") \
        .write.mode("overwrite").partitionBy("run_id").parquet(path)
    return io.read_run(spark, path).select("loanId", "y_true", "y_pred", "run_id")


@query("src_run_fallback", V.with_("scored") + """
SELECT loanId, y_true, y_pred, run_id FROM scored WHERE run_id = (SELECT max(run_id) FROM scored)""")
def src_run_fallback(spark, sf_dir):
    """A requested run that was never ingested: the lexicographically last run is read instead."""
    prep(spark)
    path = scratch_path(spark, "runs")
    fixtures.scored(spark, sf_dir).select("loanId", "y_true", "y_pred", "run_id").write.mode("overwrite").partitionBy("run_id").parquet(path)
    return io.read_run(spark, path, run_id="2031-07").select("loanId", "y_true", "y_pred", "run_id")


@query("src_latest_ref", """
WITH runs AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type, value FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM runs WHERE run_id = (SELECT max(run_id) FROM runs) GROUP BY event_type""")
def src_latest_ref(spark, sf_dir):
    """Reference statistics saved per run (one run per event day); the latest saved stats are read."""
    prep(spark)
    ev = fixtures.table(spark, sf_dir, "events")
    stats = (ev.withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))
               .groupBy("run_id", "event_type")
               .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")))
    path = scratch_path(spark, "ref-stats")
    stats.write.mode("overwrite").partitionBy("run_id").parquet(path)
    latest = io.read_run(spark, path)
    return latest.select("event_type", "n", r("mean").alias("mean"), r("std").alias("std"))


@query("sink_roundtrip", V.with_("loan") + "SELECT * FROM loan")
def sink_roundtrip(spark, sf_dir):
    """Ingest sink: the approved loans appended under run_id, read back by run id."""
    loan, _, _ = inputs(spark, sf_dir)
    path = scratch_path(spark, "ingest")
    io.write_run(loan, path, "run_a")
    return io.read_run(spark, path, run_id="run_a").select(*LOAN_COLS)


# ------------------------------------------------------------------------------------ filters & joins

@query("flt_approved", V.with_("loan_all") + """
SELECT loanId, state, loanAmount, approved FROM loan_all WHERE approved""")
def flt_approved(spark, sf_dir):
    """Approved filter (null approved excluded): the rows that ingestion keeps."""
    prep(spark)
    return fixtures.loan(spark, sf_dir).where(F.col("approved")).select("loanId", "state", "loanAmount", "approved")


JOIN_FRAUD_SQL = V.with_("joined") + "SELECT loanId, clarityFraudId, underwritingid, clearfraudscore FROM joined"


@query("join_fraud", JOIN_FRAUD_SQL)
def join_fraud(spark, sf_dir):
    loan, clarity, _ = inputs(spark, sf_dir)
    return joins.join_fraud(loan, clarity).select("loanId", "clarityFraudId", "underwritingid", "clearfraudscore")


@query("join_fraud_nullsafe", V.with_("loan", "clarity") + """
SELECT l.loanId, l.clarityFraudId, c.underwritingid, c.clearfraudscore
FROM loan l LEFT JOIN clarity c ON l.clarityFraudId IS NOT DISTINCT FROM c.underwritingid""")
def join_fraud_nullsafe(spark, sf_dir):
    loan, clarity, _ = inputs(spark, sf_dir)
    return joins.join_fraud(loan, clarity, null_safe=True).select(
        "loanId", "clarityFraudId", "underwritingid", "clearfraudscore")


_PAY_OUT = ["paymentAmount_mean", "paymentAmount_sum", "principal_mean", "principal_sum", "fees_mean", "fees_sum",
            "payment_success_rate"]


@query("agg_payment", V.with_("pay_agg") + "SELECT loanId, paymentAmount_count, "
       + ", ".join(_PAY_OUT) + " FROM pay_agg")
def agg_payment(spark, sf_dir):
    """Per-loan payment aggregates (null keys dropped, null status in the success-rate denominator)."""
    _, _, payment = inputs(spark, sf_dir)
    agg = joins.payment_aggregates(payment)
    return agg.select("loanId", "paymentAmount_count", *_PAY_OUT)


@query("fe_payment", V.with_("with_pay") + "SELECT loanId, paymentAmount_count, "
       + ", ".join(_PAY_OUT) + " FROM with_pay")
def fe_payment(spark, sf_dir):
    """Loans ⋈ payment aggregates, loans without payments filled with 0."""
    loan, _, payment = inputs(spark, sf_dir)
    df = joins.join_payments(loan, payment)
    return df.select("loanId", "paymentAmount_count", *_PAY_OUT)


TARGET_CASE = "CASE loanStatus " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.STATUS_RISK.items()) + \
    f" ELSE {C.DEFAULT_RISK} END"


@query("target_risk", V.with_("loan") + f"SELECT loanId, loanStatus, CAST({TARGET_CASE} AS DOUBLE) AS target FROM loan")
def target_risk(spark, sf_dir):
    """Risk target by status lookup (literal map, no join); unmapped and null -> 0.50."""
    loan, _, _ = inputs(spark, sf_dir)
    return loan.select("loanId", "loanStatus", status_risk("loanStatus").alias("target"))


@query("fe_dates", V.with_("loan", extra=[V.DATED.replace("FROM with_pay", "FROM loan")]) + """
SELECT loanId, application_year, application_month, application_day, application_dayofweek, application_hour,
       round(days_to_origination, 6) AS days_to_origination FROM dated""")
def fe_dates(spark, sf_dir):
    """Date texts -> parts (invalid -> null), weekday Monday=0, fractional days to origination."""
    loan, _, _ = inputs(spark, sf_dir)
    df = add_date_features(loan)
    return df.select("loanId", "application_year", "application_month", "application_day",
                     "application_dayofweek", "application_hour", r("days_to_origination").alias("days_to_origination"))


@query("status_dist", V.with_("loan") + """
SELECT loanStatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM loan WHERE loanStatus IS NOT NULL GROUP BY loanStatus""")
def status_dist(spark, sf_dir):
    """Normalised value counts of the loan status (nulls excluded)."""
    from ..operators import stats
    loan, _, _ = inputs(spark, sf_dir)
    return stats.value_shares(loan, "loanStatus").select("loanStatus", "n", r("share").alias("share"))


@query("value_shares", V.with_("loan") + """
SELECT feature, value, n, round(n / sum(n) OVER (PARTITION BY feature), 6) AS share FROM (
  SELECT feature, value, count(*) AS n FROM (
    UNPIVOT (SELECT payFrequency, state, leadType, loanStatus FROM loan)
    ON payFrequency, state, leadType, loanStatus INTO NAME feature VALUE value)
  WHERE value IS NOT NULL GROUP BY feature, value)""")
def value_shares(spark, sf_dir):
    """Shares of every value of several categorical columns in one pass (unpivot + one group-by)."""
    from ..operators import stats
    loan, _, _ = inputs(spark, sf_dir)
    out = stats.value_shares_long(loan, ["payFrequency", "state", "leadType", "loanStatus"])
    return out.select("feature", "value", "n", r("share").alias("share"))


@query("score_payfreq", V.with_("loan") + """
SELECT loanId, payFrequency,
       coalesce(CASE payFrequency WHEN 'W' THEN 'Weekly' WHEN 'B' THEN 'Biweekly' WHEN 'S' THEN 'Semimonthly'
                WHEN 'M' THEN 'Monthly' END, 'Other') AS label,
       coalesce(CASE coalesce(CASE payFrequency WHEN 'W' THEN 'Weekly' WHEN 'B' THEN 'Biweekly'
                WHEN 'S' THEN 'Semimonthly' WHEN 'M' THEN 'Monthly' END, 'Other')
                WHEN 'Weekly' THEN 'W' WHEN 'Biweekly' THEN 'B' WHEN 'Semimonthly' THEN 'S' WHEN 'Monthly' THEN 'M' END,
                'W') AS code
FROM loan""")
def score_payfreq(spark, sf_dir):
    """Form label -> pay-frequency code lookup with default 'W' (labels derived from the stored codes;
    unknown codes become the label 'Other', which maps to the default)."""
    from ..functions.expressions import lookup, pay_frequency_code
    loan, _, _ = inputs(spark, sf_dir)
    inv = {v: k for k, v in C.PAY_FREQUENCY_CODES.items()}
    label = lookup("payFrequency", inv, "Other")
    return loan.select("loanId", "payFrequency", label.alias("label"), pay_frequency_code(label).alias("code"))
