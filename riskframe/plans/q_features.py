"""Registered queries: feature build steps (fit/transform), split, target statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import features as FE
from ..operators import split as SP
from ..operators import stats as ST
from ..functions.expressions import exact_avg
from . import sql_views as V
from .common import SIG, XAVG, inputs, r, scratch_path, sig
from ..session import memo, written
from .registry import query

NUM = V.NUMERIC_BASE
IND = [f"{c}_missing" for c in C.MISSING_INDICATOR_COLUMNS]


def fitted(spark, sf_dir):
    """Base frame, fitted pipeline and spec (fit once per session and input)."""
    store = memo(spark)
    if ("fitted", sf_dir) not in store:
        store["fitted", sf_dir] = _fitted(spark, sf_dir)
    return store["fitted", sf_dir]


def _fitted(spark, sf_dir):
    loan, clarity, payment = inputs(spark, sf_dir)
    base = written(FE.base_frame(loan, clarity, payment), "base")  # joined once; the fit and the steps after it scan the table
    pipe = FE.FeaturePipeline()
    return base, pipe, pipe.fit(base, cache=False)


@query("fe_missing", V.with_("filled") + "SELECT loanId, " + ", ".join(NUM + IND) + " FROM filled")
def fe_missing(spark, sf_dir):
    """Missing handling: indicators (11 listed columns), exact-median fill, 'Unknown', False."""
    base, _, spec = fitted(spark, sf_dir)
    return FE.fill_missing(base, spec).select("loanId", *NUM, *IND)


@query("fe_interactions", V.with_("engineered") + "SELECT loanId, loanAmount_x_apr, leadCost_to_loanAmount FROM engineered")
def fe_interactions(spark, sf_dir):
    """loanAmount * apr, and leadCost / loanAmount when every filled amount is > 0 (decided at fit)."""
    base, _, spec = fitted(spark, sf_dir)
    assert spec.ratio_feature
    return FE.add_interactions(FE.fill_missing(base, spec), spec).select(
        "loanId", "loanAmount_x_apr", "leadCost_to_loanAmount")


@query("fe_polynomial", V.with_("engineered") + "SELECT loanId, loanAmount_squared, apr_squared, clearfraudscore_squared "
       "FROM engineered")
def fe_polynomial(spark, sf_dir):
    base, _, spec = fitted(spark, sf_dir)
    df = FE.add_squares(FE.fill_missing(base, spec), spec)
    return df.select("loanId", *[f"{c}_squared" for c in spec.squared])


@query("fe_target_encode", V.with_("engineered") + "SELECT loanId, payFrequency, payFrequency_target_encoded FROM engineered")
def fe_target_encode(spark, sf_dir):
    """In-sample target mean per category (originated share), lookup-joined back."""
    base, pipe, spec = fitted(spark, sf_dir)
    df = FE.apply_encodings(FE.fill_missing(base, spec), pipe.encodings, spec.encoding_global_mean)
    return df.select("loanId", "payFrequency", "payFrequency_target_encoded")


_VAR_FEATURES = (["clearfraudscore"] + list(C.PAYMENT_FEATURES) + list(C.DATE_PART_FEATURES) + ["days_to_origination"]
                 + IND + ["loanAmount_x_apr", "leadCost_to_loanAmount", "loanAmount_squared", "apr_squared",
                          "clearfraudscore_squared", "payFrequency_target_encoded"])
_VAR_SQL = V.with_("engineered", extra=[
    "v AS (UNPIVOT (SELECT " + ", ".join(f"var_samp({c}) AS {c}" for c in _VAR_FEATURES) + " FROM engineered) "
    "ON " + ", ".join(_VAR_FEATURES) + " INTO NAME feature VALUE variance)"]) + \
    f"SELECT feature, {SIG('variance')} AS variance, variance < {C.FEATURE_CONFIG['variance_threshold']} AS dropped FROM v"


@query("fe_variance", _VAR_SQL)
def fe_variance(spark, sf_dir):
    """Sample variance of every numeric feature (one aggregate) and the low-variance drop decision."""
    _, _, spec = fitted(spark, sf_dir)
    rows = [(k, v, k in spec.dropped) for k, v in spec.variances.items()]
    df = spark.createDataFrame(rows, "feature string, variance double, dropped boolean")
    return df.select("feature", sig("variance").alias("variance"), "dropped")


_FULL_DROPPED = ["application_hour", "nPaidOff_missing", "apr_missing", "leadCost_to_loanAmount",
                 "payFrequency_target_encoded"]
_FULL_SQL = V.with_("engineered") + f"""
SELECT * EXCLUDE ({", ".join(_FULL_DROPPED)}),
       CAST({V._TARGET_CASE} AS DOUBLE) AS target
FROM engineered"""


@query("features_full", _FULL_SQL)
def features_full(spark, sf_dir):
    """Whole feature build: join -> payments -> dates -> missing -> engineer -> variance drop -> target.

    The oracle fixes the column set the fit decides on this data (low-variance drops: the constant
    hour and two constant indicators, the ratio and the single-category encoding)."""
    loan, clarity, payment = inputs(spark, sf_dir)
    base = written(FE.base_frame(loan, clarity, payment), "base")
    pipe = FE.FeaturePipeline()
    spec = pipe.fit(base, cache=False)  # fitted on every call (the step queries share one fit)
    return pipe.transform(base, spec)


@query("schema_align", V.with_("filled") + "SELECT loanId, " + ", ".join(
    (f"0 AS {c}" if c in ("nPaidOff_missing", "apr_missing") else c) for c in IND) + " FROM filled")
def schema_align(spark, sf_dir):
    """Indicators the fit dropped (constant 0) are re-added as 0 for a model expecting all eleven."""
    base, pipe, spec = fitted(spark, sf_dir)
    out = pipe.transform(base, spec)
    return FE.schema_align(out, IND).select("loanId", *IND)


_SPLIT_HASH_SQL = V.with_("loan") + """
SELECT loanId, CASE WHEN ('0x' || substr(md5(loanId), 1, 8))::BIGINT % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM loan"""


@query("split_hash", _SPLIT_HASH_SQL)
def split_hash(spark, sf_dir):
    """20 % test by md5 bucket of the key: stable under repartitioning and across engines."""
    loan, _, _ = inputs(spark, sf_dir)
    return SP.hash_split(loan.select("loanId"), "loanId", C.TEST_SIZE)


_STRATA_CTE = [
    f"tgt AS (SELECT loanId, CAST({V._TARGET_CASE} AS DOUBLE) AS target FROM loan)",
    "edges AS (SELECT list_sort(list_distinct(quantile_cont(target, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM tgt)",
    "strat AS (SELECT t.loanId, t.target, CAST(len(list_filter(e[2:], lambda x: x < t.target)) AS INTEGER) AS stratum FROM tgt t, edges)",
]


@query("split_strata", V.with_("loan", extra=_STRATA_CTE) + """
SELECT stratum, count(*) AS n, count(*) >= 2 AS ok FROM strat GROUP BY stratum""")
def split_strata(spark, sf_dir):
    """Quantile risk buckets (duplicate edges dropped) and the >= 2 rows check for stratification."""
    loan, _, _ = inputs(spark, sf_dir)
    t = FE.add_target(loan.select("loanId", "loanStatus"))
    b, _ = ST.qcut(t, "target", C.N_STRATA)
    return b.groupBy(F.col("target_qbin").alias("stratum")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("ok", F.col("n") >= 2)


@query("split_stratified", V.with_("loan", extra=_STRATA_CTE) + """
SELECT loanId, stratum,
       CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5(loanId), loanId)
                 <= ceil(0.2 * count(*) OVER (PARTITION BY stratum)) THEN 'test' ELSE 'train' END AS split
FROM strat""")
def split_stratified(spark, sf_dir):
    """Per stratum the first ceil(20 %) keys in md5 order are test (two-level rank, no stratum on one task)."""
    loan, _, _ = inputs(spark, sf_dir)
    t = FE.add_target(loan.select("loanId", "loanStatus"))
    b, _ = ST.qcut(t, "target", C.N_STRATA)
    b = b.withColumnRenamed("target_qbin", "stratum").select("loanId", "stratum")
    return SP.stratified_split(b, "loanId", "stratum", C.TEST_SIZE).select("loanId", "stratum", "split")


@query("split_fallback", _SPLIT_HASH_SQL)
def split_fallback(spark, sf_dir):
    """A stratum with fewer than two rows cannot be split: the plain split is used for all rows."""
    loan, _, _ = inputs(spark, sf_dir)
    low = loan.agg(F.min("loanId")).first()[0]
    b = loan.select("loanId", F.when(F.col("loanId") == low, "alone").otherwise("rest").alias("stratum"))
    return SP.stratified_split(b, "loanId", "stratum", C.TEST_SIZE).select("loanId", "split")


@query("split_features", V.with_("loan") + f"""
SELECT CASE WHEN ('0x' || substr(md5(loanId), 1, 8))::BIGINT % 5 = 0 THEN 'test' ELSE 'train' END AS split,
       count(*) AS n, {XAVG(V._TARGET_CASE)} AS avg_target
FROM loan GROUP BY 1""")
def split_features(spark, sf_dir):
    """Train/test feature sink: one table partitioned by ``split`` (features and target together)."""
    loan, _, _ = inputs(spark, sf_dir)
    df = SP.hash_split(FE.add_target(loan), "loanId", C.TEST_SIZE)
    path = scratch_path(spark, "features")
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), exact_avg("target").alias("avg_target"))


@query("target_stats", V.with_("loan", extra=[f"tgt AS (SELECT CAST({V._TARGET_CASE} AS DOUBLE) AS target FROM loan)"])
       + f"""SELECT count(target) AS count, {XAVG('target')} AS mean, quantile_cont(target, 0.5) AS median,
       min(target) AS min, max(target) AS max, round(stddev_samp(target), 6) AS std FROM tgt""")
def target_stats(spark, sf_dir):
    """Target distribution: mean, exact median, min, max, std (ddof 1)."""
    loan, _, _ = inputs(spark, sf_dir)
    t = FE.add_target(loan.select("loanStatus"))
    m = t.agg(F.count("target").alias("count"), exact_avg("target").alias("mean"), F.min("target").alias("min"),
              F.max("target").alias("max"), r(F.stddev_samp("target")).alias("std"))
    from ..operators import ranking
    med = ranking.quantiles(t, [], "target", {"median": 0.5})
    return ranking.join_small(m, med, [], 1).select("count", "mean", "median", "min", "max", "std")


@query("target_cardinality", V.with_("loan", extra=[f"tgt AS (SELECT CAST({V._TARGET_CASE} AS DOUBLE) AS target FROM loan)"])
       + "SELECT count(DISTINCT target) AS nunique, count(DISTINCT target) <= 10 AS classifier_path FROM tgt")
def target_cardinality(spark, sf_dir):
    """Distinct target values (nulls excluded) and the learner choice (<= 10 -> classifier).

    Exact distinct count by group-then-count (shuffled on the value), not a single-task set merge."""
    loan, _, _ = inputs(spark, sf_dir)
    t = FE.add_target(loan.select("loanStatus"))
    d = t.where(F.col("target").isNotNull()).groupBy("target").count()
    return d.agg(F.count(F.lit(1)).alias("nunique")).withColumn("classifier_path", F.col("nunique") <= 10)
