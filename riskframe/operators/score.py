"""Scoring: request defaults, synthetic companion rows, batch and stream scoring, bands.

A request table (any number of rows) goes through the same fitted feature spec as training
(``FeaturePipeline.transform``), then the saved MLlib pipeline; bands are column expressions.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.expressions import app_band, decision, pay_frequency_code, serving_band
from .model import task_of


def input_defaults(loan: DataFrame, clarity_present: bool) -> DataFrame:
    """Fill scoring-time input columns a request may lack."""
    cols = {}
    if "hasCF" not in loan.columns:
        cols["hasCF"] = F.lit(bool(clarity_present))
    if "anon_ssn" not in loan.columns:
        cols["anon_ssn"] = F.concat(F.lit("anonymous-"), F.col("loanId").cast("string"))
    if "isFunded" not in loan.columns:
        cols["isFunded"] = F.col("approved") if "approved" in loan.columns else F.lit(True)
    if "originallyScheduledPaymentAmount" not in loan.columns:
        cols["originallyScheduledPaymentAmount"] = (F.col("loanAmount") / 12 if "loanAmount" in loan.columns
                                                    else F.lit(0.0))
    return loan.withColumns(cols) if cols else loan


def output_defaults(processed: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Defaults for expected model columns the processed request lacks; a fraud score that only the request
    itself carries is joined from it by loan id."""
    out = processed
    if "clearfraudscore" not in out.columns and source is not None and "clearfraudscore" in source.columns:
        out = out.join(source.select("loanId", "clearfraudscore").dropDuplicates(["loanId"]), "loanId", "left")
    cols = {c: F.lit(v) for c, v in C.SCORE_OUTPUT_DEFAULTS.items() if c not in out.columns}
    if "clearfraudscore_squared" not in out.columns and "clearfraudscore" in out.columns:
        cols["clearfraudscore_squared"] = F.col("clearfraudscore") * F.col("clearfraudscore")
    return out.withColumns(cols) if cols else out


def form_requests(forms: DataFrame) -> DataFrame:
    """Entry forms (loan_amount, apr, pay_frequency, state, lead_type, n_paid_off, lead_cost, clear_fraud_score) as
    loan requests."""
    return forms.select(
        "loanId", F.col("loan_amount").cast("double").alias("loanAmount"), F.col("apr").cast("double").alias("apr"),
        pay_frequency_code("pay_frequency").alias("payFrequency"), "state", F.col("lead_type").alias("leadType"),
        F.col("n_paid_off").cast("double").alias("nPaidOff"), F.col("lead_cost").cast("double").alias("leadCost"),
        F.lit(True).alias("approved"), F.lit(True).alias("originated"), F.col("applicationDate"),
        F.concat(F.lit("CF_"), F.col("clear_fraud_score").cast("string")).alias("clarityFraudId"),
        F.lit("New Loan").alias("loanStatus"), F.lit("None").alias("fpStatus"))


def form_clarity(forms: DataFrame) -> DataFrame:
    """Fraud-score rows of entry forms: the entered score under the id CF_<score>."""
    return forms.select(F.concat(F.lit("CF_"), F.col("clear_fraud_score").cast("string")).alias("underwritingid"),
                        F.col("clear_fraud_score").cast("double").alias("clearfraudscore")).distinct()


def form_payment(forms: DataFrame) -> DataFrame:
    """One successful installment per entry form: amount/12, principal amount/15, fees amount/60."""
    a = F.col("loan_amount").cast("double")
    return forms.select("loanId", F.lit(1).alias("installmentIndex"), (a / 12).alias("paymentAmount"),
                        F.lit(C.PAYMENT_SUCCESS_STATUS).alias("paymentStatus"), (a / 15).alias("principal"), (a / 60).alias("fees"))


def synthetic_clarity(loan: DataFrame) -> DataFrame:
    """One fraud-score row per distinct fraud id (score 300) when no clarity data comes with requests."""
    return loan.select(F.col("clarityFraudId").alias("underwritingid")).distinct() \
        .withColumn("clearfraudscore", F.lit(float(C.SYNTHETIC_FRAUD_SCORE)))


def synthetic_payment(loan: DataFrame) -> DataFrame:
    """One synthetic installment per loan: amount/12, principal amount/15, fees amount/30, status Late."""
    first = loan.dropDuplicates(["loanId"]).select("loanId", "loanAmount")
    a = F.col("loanAmount")
    return first.select("loanId", F.lit(1).alias("installmentIndex"), (a / 12).alias("paymentAmount"),
                        F.lit("Late").alias("paymentStatus"), (a / 15).alias("principal"), (a / 30).alias("fees"))


def score(model: PipelineModel, features: DataFrame, task: str | None = None,
          threshold: float = C.PREDICTION_THRESHOLD) -> DataFrame:
    """Batch or stream scoring with a fitted pipeline: regression -> value + serving band; two classes -> P(class 1) +
    decision; more classes -> the class label and its probability. The task is read from the model if not given."""
    out = model.transform(features)
    task = task or task_of(model)
    if task == "regression":
        return out.withColumn("risk_category", serving_band("prediction")).withColumn(
            "risk_level", app_band("prediction"))
    from pyspark.ml.functions import vector_to_array
    if task == "multiclass":
        return out.withColumn("probability_max", F.array_max(vector_to_array("probability")))
    p1 = vector_to_array("probability")[1]
    return out.withColumn("p1", p1).withColumn("decision", decision("p1", threshold))
