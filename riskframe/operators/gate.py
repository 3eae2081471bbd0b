"""Deployment gate, decision and model registry as DataFrame operations over metric tables.

The gate runs per evaluation row (e.g. per run): an improvement check against production (primary
metric difference below the threshold refuses), then absolute minima; the reasons are kept as a list so
a refusal is explainable. The registry is an append-only table; the current model is
``max_by(model_version, deployment_date)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def gate(df: DataFrame, has_production: Column, metric_diff: Column, *, task: str = "regression",
         min_accuracy: float = C.DEPLOY_MIN_ACCURACY, min_r2: float = C.DEPLOY_MIN_R2,
         min_precision: float = C.DEPLOY_MIN_PRECISION, min_roc_auc: float = C.DEPLOY_MIN_ROC_AUC,
         improvement_threshold: float = C.IMPROVEMENT_THRESHOLD) -> DataFrame:
    """Adds ``failed_checks`` (array of check names) and ``passed``.

    Regression: accuracy, r2, precision_macro minima. Classification: accuracy, roc_auc (when present),
    precision minima. A missing metric difference counts as 0 (so with a production model present and
    no comparison of the primary metric the gate refuses).
    """
    checks = [F.when(has_production & (F.coalesce(metric_diff, F.lit(0.0)) < improvement_threshold),
                     F.lit("improvement"))]
    checks.append(F.when(F.col("accuracy") < min_accuracy, F.lit("accuracy")))
    if task == "regression":
        checks.append(F.when(F.col("r2") < min_r2, F.lit("r2")))
        checks.append(F.when(F.col("precision_macro") < min_precision, F.lit("precision")))
    else:
        if "roc_auc" in df.columns:
            checks.append(F.when(F.col("roc_auc") < min_roc_auc, F.lit("roc_auc")))
        checks.append(F.when(F.col("precision") < min_precision, F.lit("precision")))
    failed = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.withColumn("failed_checks", failed).withColumn("passed", F.size("failed_checks") == 0)


def decision(gated: DataFrame, has_production: Column, force: bool = False) -> DataFrame:
    """force -> deploy; no production model -> deploy if the minima pass; else the gate."""
    minima_ok = F.size(F.filter(F.col("failed_checks"), lambda x: x != "improvement")) == 0
    d = F.lit(True) if force else F.when(~has_production, minima_ok).otherwise(F.col("passed"))
    return gated.withColumn("deploy", d)


def registry_current(registry: DataFrame) -> DataFrame:
    """Current production version: the latest deployment."""
    return registry.agg(F.max_by("model_version", "deployment_date").alias("current_version"),
                        F.max("deployment_date").alias("deployment_date"),
                        F.count(F.lit(1)).alias("n_deployments"))
