"""Explicit schemas of the domain tables (no inference on read)."""

from pyspark.sql import types as T

LOAN = T.StructType([
    T.StructField("loanId", T.StringType()),
    T.StructField("anon_ssn", T.StringType()),
    T.StructField("payFrequency", T.StringType()),
    T.StructField("apr", T.DoubleType()),
    T.StructField("applicationDate", T.StringType()),
    T.StructField("originated", T.BooleanType()),
    T.StructField("originatedDate", T.StringType()),
    T.StructField("nPaidOff", T.DoubleType()),
    T.StructField("approved", T.BooleanType()),
    T.StructField("isFunded", T.BooleanType()),
    T.StructField("loanStatus", T.StringType()),
    T.StructField("loanAmount", T.DoubleType()),
    T.StructField("state", T.StringType()),
    T.StructField("leadType", T.StringType()),
    T.StructField("leadCost", T.DoubleType()),
    T.StructField("clarityFraudId", T.StringType()),
])

CLARITY = T.StructType([
    T.StructField("underwritingid", T.StringType()),
    T.StructField("clearfraudscore", T.DoubleType()),
])

PAYMENT = T.StructType([
    T.StructField("loanId", T.StringType()),
    T.StructField("installmentIndex", T.IntegerType()),
    T.StructField("paymentAmount", T.DoubleType()),
    T.StructField("paymentStatus", T.StringType()),
    T.StructField("principal", T.DoubleType()),
    T.StructField("fees", T.DoubleType()),
])

PAYMENT_REQUIRED = ["loanId", "paymentAmount", "paymentStatus"]
LOAN_REQUIRED = ["loanId", "loanStatus", "clarityFraudId"]
CLARITY_REQUIRED = ["underwritingid", "clearfraudscore"]

SCORED = T.StructType([
    T.StructField("loanId", T.StringType()),
    T.StructField("y_true", T.DoubleType()),
    T.StructField("y_pred", T.DoubleType()),
])

PERF_HISTORY = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
])

REGISTRY = T.StructType([
    T.StructField("model_version", T.StringType()),
    T.StructField("deployment_date", T.TimestampType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("task", T.StringType()),
])
