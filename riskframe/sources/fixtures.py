"""Domain views (loan, clarity, payment, drift, scored) derived from the driver's test tables.

The derivation is deterministic key arithmetic, so the SQL oracle (``plans/sql_views.py``) derives exactly the
same rows. Every view is a lazy DataFrame over the Parquet scans: filters and projections applied by
callers reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..session import memo

# Status names indexed by key arithmetic (1-based position = o_orderkey % 15 + 1), in the order of the risk table.
STATUS_SEQUENCE = list(C.STATUS_RISK)
PRIORITY_FREQUENCY = {"1-URGENT": "W", "2-HIGH": "B", "3-MEDIUM": "S", "5-LOW": "M"}
DRIFT_SPLIT_TS = "2024-01-16 00:00:00"
ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss"


def _cached(spark: SparkSession, key: tuple, build):
    """Per-session cache of lazy plans (not data): re-reading Parquet footers and re-building the view
    expressions costs driver round trips on every query otherwise."""
    plans = memo(spark)
    if key not in plans:
        plans[key] = build()
    return plans[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return _cached(spark, ("table", path), lambda: spark.read.parquet(path))


def loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, ("loan", sf_dir), lambda: _loan(spark, sf_dir))


def _loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation -> loan applications (all, not only approved)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation has 25 rows by definition of the schema: a size-bounded broadcast.
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    k = F.col("o_orderkey")
    status_arr = F.array(*[F.lit(s) for s in STATUS_SEQUENCE])
    pf = F.col("o_orderpriority")
    pay_freq = None
    for p, code in PRIORITY_FREQUENCY.items():
        pay_freq = (F.when(pf == p, code) if pay_freq is None else pay_freq.when(pf == p, code))
    orig_ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 10000).cast("int"))
    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
          .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "inner"))
    return j.select(
        F.concat(F.lit("L"), k.cast("string")).alias("loanId"),
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("anon_ssn"),
        pay_freq.alias("payFrequency"),
        (F.lit(100.0) + (k * 37) % 600).cast("double").alias("apr"),
        F.when(k % 31 == 0, F.lit("not-a-date"))
         .otherwise(F.date_format(F.col("o_orderdate"), ISO_FMT)).alias("applicationDate"),
        (F.col("o_orderstatus") != "P").alias("originated"),
        F.when(F.col("o_orderstatus") != "P", F.date_format(orig_ts, ISO_FMT)).alias("originatedDate"),
        (k % 5).cast("double").alias("nPaidOff"),
        (k % 10 != 0).alias("approved"),
        (F.col("o_orderstatus") == "F").alias("isFunded"),
        F.when(k % 29 == 0, F.lit(None).cast("string"))
         .when(k % 23 == 0, F.lit("Other Status"))
         .otherwise(F.element_at(status_arr, (k % 15 + 1).cast("int"))).alias("loanStatus"),
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice") / 100).alias("loanAmount"),
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("leadType"),
        F.when(k % 13 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("o_custkey") % 20).cast("double")).alias("leadCost"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("clarityFraudId"),
    )


def clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, ("clarity", sf_dir), lambda: _clarity(spark, sf_dir))


def _clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.where(key % 4 != 0).select(
        F.concat(F.lit("C"), key.cast("string")).alias("underwritingid"),
        F.when(key % 9 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal") / 10).alias("clearfraudscore"),
    )


def payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, ("payment", sf_dir), lambda: _payment(spark, sf_dir))


def _payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rf = F.col("l_returnflag")
    return li.select(
        F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("loanId"),
        F.col("l_linenumber").cast("int").alias("installmentIndex"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice") / 100).alias("paymentAmount"),
        F.when(rf == "N", "Checked").when(rf == "R", "Rejected").alias("paymentStatus"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100).alias("principal"),
        (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("fees"),
    )


def drift_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events split into a reference window and a new window; numeric `value`, categorical `event_type`."""
    ev = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    split = F.to_timestamp_ntz(F.lit(DRIFT_SPLIT_TS))
    ref = ev.where(F.col("ts") < split).select("value", "event_type")
    new = ev.where(F.col("ts") >= split).select("value", "event_type")
    return ref, new


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, ("scored", sf_dir), lambda: _scored(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic pseudo-scores per order, so evaluation metrics have an exact oracle.

    ``run_id`` is the order month (yyyy-MM): each month plays one evaluation run; ``y_prod`` is the
    score of a second, better model (``y_true`` plus a deterministic error within +-0.05) used as
    the challenger in model comparison and deployment gating.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("L"), k.cast("string")).alias("loanId"),
        F.date_format(F.col("o_orderdate"), "yyyy-MM").alias("run_id"),
        F.col("o_orderdate").cast("date").alias("score_date"),
        (((k * 104729) % 1000) / 1000.0).cast("double").alias("y_true"),
        (((k * 7919) % 1000) / 1000.0).cast("double").alias("y_pred"),
        ((((k * 104729) % 1000) + (k * 7919) % 101 - 50) / 1000.0).cast("double").alias("y_alt"),
    )


def approved_loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest filter: approved applications only (null approved is excluded)."""
    return _cached(spark, ("approved_loan", sf_dir), lambda: loan(spark, sf_dir).where(F.col("approved")))

