"""SQL (DuckDB dialect) text of the domain views, used to build the oracle statements.

Each constant is a list of ``name AS (...)`` CTE items over the driver's pre-registered tables; ``with_``
joins the needed ones into a ``WITH`` clause. The derivations mirror ``sources/fixtures.py``.
"""

from __future__ import annotations

from ..functions import constants as C
from .common import XAVG, XSUM
from ..sources.fixtures import DRIFT_SPLIT_TS, PRIORITY_FREQUENCY, STATUS_SEQUENCE


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STATUS_LIST = "[" + ", ".join(_sql_str(s) for s in STATUS_SEQUENCE) + "]"
_PAYFREQ_CASE = "CASE o_orderpriority " + " ".join(
    f"WHEN {_sql_str(p)} THEN {_sql_str(c)}" for p, c in PRIORITY_FREQUENCY.items()) + " END"

LOAN_ALL = f"""loan_all AS (
  SELECT 'L' || o_orderkey AS loanId,
         'S' || o_custkey AS anon_ssn,
         {_PAYFREQ_CASE} AS payFrequency,
         CAST(100.0 + (o_orderkey * 37) % 600 AS DOUBLE) AS apr,
         CASE WHEN o_orderkey % 31 = 0 THEN 'not-a-date'
              ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS applicationDate,
         o_orderstatus <> 'P' AS originated,
         CASE WHEN o_orderstatus <> 'P'
              THEN strftime(o_orderdate + INTERVAL 1 MINUTE * CAST(o_orderkey % 10000 AS INTEGER), '%Y-%m-%dT%H:%M:%S')
         END AS originatedDate,
         CAST(o_orderkey % 5 AS DOUBLE) AS nPaidOff,
         o_orderkey % 10 <> 0 AS approved,
         o_orderstatus = 'F' AS isFunded,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL
              WHEN o_orderkey % 23 = 0 THEN 'Other Status'
              ELSE list_extract({_STATUS_LIST}, CAST(o_orderkey % 15 + 1 AS INTEGER)) END AS loanStatus,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 100 END AS loanAmount,
         n_name AS state,
         c_mktsegment AS leadType,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 20 AS DOUBLE) END AS leadCost,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'C' || o_custkey END AS clarityFraudId
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

LOAN = "loan AS (SELECT * FROM loan_all WHERE approved)"

CLARITY = """clarity AS (
  SELECT 'C' || c_custkey AS underwritingid,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal / 10 END AS clearfraudscore
  FROM customer WHERE c_custkey % 4 <> 0
)"""

PAYMENT = """payment AS (
  SELECT 'L' || l_orderkey AS loanId,
         CAST(l_linenumber AS INTEGER) AS installmentIndex,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 100 END AS paymentAmount,
         CASE l_returnflag WHEN 'N' THEN 'Checked' WHEN 'R' THEN 'Rejected' END AS paymentStatus,
         l_extendedprice * (1 - l_discount) / 100 AS principal,
         l_extendedprice * l_tax / 100 AS fees
  FROM lineitem
)"""

PAY_AGG = f"""pay_agg AS (
  SELECT loanId,
         {XAVG("paymentAmount")} AS paymentAmount_mean,
         coalesce({XSUM("paymentAmount")}, 0) AS paymentAmount_sum,
         count(paymentAmount) AS paymentAmount_count,
         {XAVG("principal")} AS principal_mean,
         coalesce({XSUM("principal")}, 0) AS principal_sum,
         {XAVG("fees")} AS fees_mean,
         coalesce({XSUM("fees")}, 0) AS fees_sum,
         CAST(count(*) FILTER (WHERE paymentStatus = '{C.PAYMENT_SUCCESS_STATUS}') AS DOUBLE) / count(*) AS payment_success_rate
  FROM payment WHERE loanId IS NOT NULL GROUP BY loanId
)"""

JOINED = """joined AS (
  SELECT l.*, c.underwritingid, c.clearfraudscore
  FROM loan l LEFT JOIN clarity c ON l.clarityFraudId = c.underwritingid
)"""

WITH_PAY = """with_pay AS (
  SELECT j.*,
         coalesce(p.paymentAmount_mean, 0) AS paymentAmount_mean,
         coalesce(p.paymentAmount_sum, 0) AS paymentAmount_sum,
         CAST(coalesce(p.paymentAmount_count, 0) AS DOUBLE) AS paymentAmount_count,
         coalesce(p.principal_mean, 0) AS principal_mean,
         coalesce(p.principal_sum, 0) AS principal_sum,
         coalesce(p.fees_mean, 0) AS fees_mean,
         coalesce(p.fees_sum, 0) AS fees_sum,
         coalesce(p.payment_success_rate, 0) AS payment_success_rate
  FROM joined j LEFT JOIN pay_agg p ON j.loanId = p.loanId
)"""

DATED = """dated AS (
  SELECT * EXCLUDE (app_ts, orig_ts),
         CAST(year(app_ts) AS DOUBLE) AS application_year,
         CAST(month(app_ts) AS DOUBLE) AS application_month,
         CAST(day(app_ts) AS DOUBLE) AS application_day,
         CAST(isodow(app_ts) - 1 AS DOUBLE) AS application_dayofweek,
         CAST(hour(app_ts) AS DOUBLE) AS application_hour,
         (epoch_us(orig_ts) - epoch_us(app_ts)) / 86400e6 AS days_to_origination
  FROM (SELECT *, try_cast(applicationDate AS TIMESTAMP) AS app_ts,
               try_cast(originatedDate AS TIMESTAMP) AS orig_ts FROM with_pay)
)"""

SCORED = """scored AS (
  SELECT 'L' || o_orderkey AS loanId,
         strftime(o_orderdate, '%Y-%m') AS run_id,
         CAST(o_orderdate AS DATE) AS score_date,
         CAST(((o_orderkey * 104729) % 1000) / 1000.0 AS DOUBLE) AS y_true,
         CAST(((o_orderkey * 7919) % 1000) / 1000.0 AS DOUBLE) AS y_pred,
         CAST((((o_orderkey * 104729) % 1000) + (o_orderkey * 7919) % 101 - 50) / 1000.0 AS DOUBLE) AS y_alt
  FROM orders
)"""

DRIFT = f"""ref AS (SELECT value, event_type FROM events WHERE ts < TIMESTAMP '{DRIFT_SPLIT_TS}'),
new AS (SELECT value, event_type FROM events WHERE ts >= TIMESTAMP '{DRIFT_SPLIT_TS}')"""

# Dependency order of the named CTE items.
_ITEMS = {
    "loan_all": (LOAN_ALL, []),
    "loan": (LOAN, ["loan_all"]),
    "clarity": (CLARITY, []),
    "payment": (PAYMENT, []),
    "pay_agg": (PAY_AGG, ["payment"]),
    "joined": (JOINED, ["loan", "clarity"]),
    "with_pay": (WITH_PAY, ["joined", "pay_agg"]),
    "dated": (DATED, ["with_pay"]),
    "scored": (SCORED, []),
    "drift": (DRIFT, []),
}


def with_(*names: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named views (and their dependencies) plus extra CTE items."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _ITEMS[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    items = [_ITEMS[n][0] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(items) + "\n"


# ----------------------------------------------------------------------------- feature build (fit)
NUMERIC_BASE = ["apr", "nPaidOff", "loanAmount", "leadCost", "clearfraudscore",
                "paymentAmount_mean", "paymentAmount_sum", "paymentAmount_count", "principal_mean",
                "principal_sum", "fees_mean", "fees_sum", "payment_success_rate",
                "application_year", "application_month", "application_day", "application_dayofweek",
                "application_hour", "days_to_origination"]
STRING_BASE = ["loanId", "anon_ssn", "payFrequency", "loanStatus", "state", "leadType", "clarityFraudId",
               "underwritingid"]
BOOL_BASE = ["originated", "approved", "isFunded"]

MED = "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC_BASE) + " FROM dated)"

FILLED = ("filled AS (SELECT d.* EXCLUDE (applicationDate, originatedDate) REPLACE ("
          + ", ".join([f"coalesce(d.{c}, m.{c}) AS {c}" for c in NUMERIC_BASE]
                      + [f"coalesce(d.{c}, 'Unknown') AS {c}" for c in STRING_BASE]
                      + [f"coalesce(d.{c}, false) AS {c}" for c in BOOL_BASE]) + "), "
          + ", ".join(f"CAST(d.{c} IS NULL AS INTEGER) AS {c}_missing" for c in C.MISSING_INDICATOR_COLUMNS)
          + " FROM dated d, med m)")

ENC = """enc AS (SELECT payFrequency, avg(CAST(originated AS INTEGER)) AS payFrequency_target_encoded
                 FROM filled GROUP BY payFrequency)"""

ENGINEERED = """engineered AS (
  SELECT f.*, f.loanAmount * f.apr AS loanAmount_x_apr,
         f.leadCost / f.loanAmount AS leadCost_to_loanAmount,
         f.loanAmount * f.loanAmount AS loanAmount_squared,
         f.apr * f.apr AS apr_squared,
         f.clearfraudscore * f.clearfraudscore AS clearfraudscore_squared,
         e.payFrequency_target_encoded
  FROM filled f LEFT JOIN enc e ON f.payFrequency = e.payFrequency
)"""

_ITEMS.update({
    "med": (MED, ["dated"]),
    "filled": (FILLED, ["dated", "med"]),
    "enc": (ENC, ["filled"]),
    "engineered": (ENGINEERED, ["filled", "enc"]),
})

_TARGET_CASE = ("CASE loanStatus " + " ".join(f"WHEN {_sql_str(k)} THEN {v}" for k, v in C.STATUS_RISK.items())
                + f" ELSE {C.DEFAULT_RISK} END")
