"""Fixed values that must equal the original pipeline's for identical results.

FIXED VALUES — keep as written.
"""

# Loan status -> risk score (target definition). Any other status, including a filled 'Unknown', gets
# DEFAULT_RISK.
STATUS_RISK = {
    "Rejected": 0.95,
    "Withdrawn Application": 0.85,
    "External Collection": 0.80,
    "Internal Collection": 0.75,
    "Returned Item": 0.65,
    "Pending Rescind": 0.55,
    "Pending Application Fee": 0.50,
    "Pending Paid Off": 0.45,
    "Settled Bankruptcy": 0.30,
    "Paid Off Loan": 0.20,
    "Settlement Paid Off": 0.15,
    "Settlement Pending Paid Off": 0.10,
    "Customer Voided New Loan": 0.05,
    "CSR Voided New Loan": 0.05,
    "New Loan": 0.40,
}
DEFAULT_RISK = 0.50

# Numeric columns that get a `<name>_missing` 0/1 indicator (added as constant 0 when absent).
MISSING_INDICATOR_COLUMNS = [
    "days_to_origination", "nPaidOff", "clearfraudscore",
    "application_year", "application_month", "application_day",
    "application_dayofweek", "application_hour",
    "loanAmount", "apr", "leadCost",
]

# Pay-frequency form label -> code; anything else -> "W".
PAY_FREQUENCY_CODES = {"Weekly": "W", "Biweekly": "B", "Semimonthly": "S", "Monthly": "M"}
DEFAULT_PAY_FREQUENCY = "W"

# Base feature lists used only when the running lists are empty.
BASE_NUMERIC = ["loanAmount", "apr", "nPaidOff", "leadCost"]
BASE_CATEGORICAL = ["state", "leadType", "payFrequency"]

# Payment aggregate columns, in output order.
PAYMENT_FEATURES = [
    "paymentAmount_mean", "paymentAmount_sum", "paymentAmount_count",
    "principal_mean", "principal_sum", "fees_mean", "fees_sum",
    "payment_success_rate",
]
PAYMENT_SUCCESS_STATUS = "Checked"

DATE_PART_FEATURES = [
    "application_year", "application_month", "application_day",
    "application_dayofweek", "application_hour",
]
DATE_COLUMNS = ["applicationDate", "originatedDate"]

# Default configuration of the feature step (pipeline configuration file).
FEATURE_CONFIG = {
    "create_interactions": True,
    "polynomial_features": True,
    "polynomial_features_list": ["loanAmount", "apr", "clearfraudscore"],
    "categorical_encoding": "target",
    "drop_low_variance": True,
    "variance_threshold": 0.02,
}

# Risk bands: evaluation (<=0.3 low, <=0.7 medium, else high), serving strings (same cut points,
# strict >), single-request page (<=0.4 low, >=0.6 high), display range -1..5.
EVAL_LOW_MAX, EVAL_HIGH_MIN = 0.3, 0.7
APP_LOW_MAX, APP_HIGH_MIN = 0.4, 0.6
DISPLAY_MIN, DISPLAY_MAX = -1.0, 5.0

# Monitoring thresholds (configuration file values) and the code defaults.
DRIFT_THRESHOLD = 0.15
CATEGORICAL_DRIFT_THRESHOLD = 0.15
KS_THRESHOLD = 0.15
MIN_ACCURACY_MONITOR = 0.7
MIN_F1_MONITOR = 0.6
RELATIVE_DEGRADATION_THRESHOLD = -0.1
MAX_MSE_INCREASE = 0.05
MAX_MAE_INCREASE = 0.03
MIN_R2_MONITOR = 0.3
HISTORY_KEEP = 100
RELATIVE_EPS = 1e-10

# Drift detection method: standard errors above the best error rate, and rows before the first minimum.
CONCEPT_WARNING = 2.0
CONCEPT_DRIFT = 3.0
CONCEPT_LEAST = 30

# Deployment thresholds (configuration file values).
DEPLOY_MIN_ACCURACY = 0.6
DEPLOY_MIN_R2 = 0.3
DEPLOY_MIN_PRECISION = 0.5
DEPLOY_MIN_ROC_AUC = 0.75
IMPROVEMENT_THRESHOLD = 0.01
PREDICTION_THRESHOLD = 0.5

# Scoring-time output defaults for columns the processed request lacks.
SCORE_OUTPUT_DEFAULTS = {
    "days_to_origination": 1,
    "paymentAmount_mean": 0.0, "principal_mean": 0.0, "fees_mean": 0.0,
    "paymentAmount_sum": 0, "principal_sum": 0, "fees_sum": 0, "paymentAmount_count": 0,
    "payment_success_rate": 1.0,
    "fpStatus": "None",
}
SYNTHETIC_FRAUD_SCORE = 300

# Columns kept out of the model inputs (ids, join keys, target source).
LEAKAGE_EXCLUDE = ["loanId", "anon_ssn", "clarityFraudId", "underwritingid", "loanStatus", "originated"]

# Train/test split.
TEST_SIZE = 0.2
N_STRATA = 5
