"""Model evaluation on a scored table (``y_true``, ``y_pred`` columns), optionally per group (e.g. run).

* regression: MSE, MAE, R² (SST = 0 -> 1 if SSE = 0 else 0) from exact sums, one aggregate pass;
* three risk bands of truth and prediction -> confusion counts (one small grouped aggregate: at most
  groups x 9 rows), from which accuracy, per-class and macro/weighted precision, recall and F1 are derived
  without another scan (labels = union of true and predicted bands present; 0/0 -> 0);
* percentile of every prediction within the actuals (rank rule) via the distributed running counts of
  ``ranking.percentile_of_score``;
* band shares in percent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.expressions import band3, exact_avg, exact_sum
from ..session import written
from . import ranking

LABELS = [0, 1, 2]
LIMITS = (C.EVAL_LOW_MAX, C.EVAL_HIGH_MIN)  # default band limits; a deployment may set its own


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def regression_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred", group_cols: list[str] | None = None) -> DataFrame:
    g = list(group_cols or [])
    err = F.col(y) - F.col(p)
    sums = [F.count(F.lit(1)).alias("n"), exact_sum(err * err).alias("sse"), exact_sum(F.abs(err)).alias("sae"),
            F.var_pop(F.col(y)).alias("vy")]
    agg = df.groupBy(*g).agg(*sums) if g else df.agg(*sums)
    sst = F.col("vy") * F.col("n")
    r2 = F.when(sst == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - F.col("sse") / sst)
    return agg.select(*g, "n", (F.col("sse") / F.col("n")).alias("mse"), (F.col("sae") / F.col("n")).alias("mae"),
                      r2.alias("r2"))


def band_counts(df: DataFrame, y: str = "y_true", p: str = "y_pred", group_cols: list[str] | None = None,
                limits: tuple[float, float] = LIMITS) -> DataFrame:
    """Confusion counts of the 3-band discretisation: ``group_cols, actual, predicted, n`` (non-empty cells)."""
    g = list(group_cols or [])
    b = df.select(*g, band3(y, *limits).alias("actual"), band3(p, *limits).alias("predicted"))
    return b.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull()) \
        .groupBy(*g, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Full grid over the labels present (true or predicted) per group, zeros included."""
    g = list(group_cols or [])
    labels_t = counts.select(*g, F.col("actual").alias("label"))
    labels_p = counts.select(*g, F.col("predicted").alias("label"))
    labels = labels_t.unionByName(labels_p).distinct()
    # labels x labels per group: at most 3 x 3 rows per group.
    a, b = labels.withColumnRenamed("label", "actual"), labels.withColumnRenamed("label", "predicted")
    grid = a.join(b, g, "inner") if g else ranking.join_small(a, b, [], len(LABELS))
    out = grid.join(counts, g + ["actual", "predicted"], "left")
    return out.select(*g, "actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def per_class(counts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Per-label precision, recall, F1 and support from confusion counts (small input)."""
    g = list(group_cols or [])
    tp = counts.where(F.col("actual") == F.col("predicted")).select(*g, F.col("actual").alias("label"),
                                                                     F.col("n").alias("tp"))
    sup = counts.groupBy(*g, F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    pred = counts.groupBy(*g, F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    keys = g + ["label"]
    labels = sup.select(*keys).unionByName(pred.select(*keys)).distinct()
    j = labels.join(tp, keys, "left").join(sup, keys, "left").join(pred, keys, "left").fillna(
        0, subset=["tp", "support", "predicted_n"])
    prec = _safe_div(F.col("tp"), F.col("predicted_n"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    j = j.select(*keys, "tp", "support", "predicted_n", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return j.withColumn("f1", f1)


def classification_metrics(counts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """accuracy and macro precision/recall/F1 per group."""
    g = list(group_cols or [])
    pc = per_class(counts, g)
    aggs = [F.sum("tp").alias("__tp"), F.sum("support").alias("__n"), F.avg("precision").alias("precision_macro"),
            F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro")]
    m = pc.groupBy(*g).agg(*aggs) if g else pc.agg(*aggs)
    return m.select(*g, (F.col("__tp") / F.col("__n")).alias("accuracy"), "precision_macro", "recall_macro", "f1_macro")


def class_report(counts: DataFrame) -> DataFrame:
    """Per-class rows plus 'macro avg' and 'weighted avg' rows (precision, recall, f1, support)."""
    pc = per_class(counts)
    rows = pc.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    w = F.col("support")
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * w) / F.sum(w)).alias("precision"),
                      (F.sum(F.col("recall") * w) / F.sum(w)).alias("recall"),
                      (F.sum(F.col("f1") * w) / F.sum(w)).alias("f1"), F.sum(w).alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def band_shares(df: DataFrame, col: str, group_cols: list[str] | None = None, limits: tuple[float, float] = LIMITS) -> DataFrame:
    """Percent of rows in the low/medium/high band of a score column."""
    g = list(group_cols or [])
    b = band3(col, *limits)
    aggs = [(F.sum(F.when(b == k, 1).otherwise(0)) * 100.0 / F.count(F.lit(1))).alias(n)
            for k, n in zip(LABELS, ["low_risk", "medium_risk", "high_risk"])]
    return df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)


def percentile_summary(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Percentile (0-1) of each prediction among the actuals: mean, min, max, std (ddof 0), plus the
    prediction mean and std (ddof 0)."""
    pct = written(ranking.percentile_of_score(df, y, df, p), "percentiles")  # ranked once, read twice
    w = F.col("weight")
    s = pct.agg(exact_sum(F.col("pct") * w).alias("s1"), F.sum(w).alias("n"), F.min("pct").alias("pct_min"), F.max("pct").alias("pct_max"))
    s = s.withColumn("pct_mean", F.col("s1") / F.col("n"))
    # spread around the mean, not the difference of two large sums
    dev = ranking.join_small(pct, s.select("pct_mean"), [], 1).agg(F.sum(w * F.pow(F.col("pct") - F.col("pct_mean"), 2)).alias("ss"))
    s = ranking.join_small(s, dev, [], 1).select("pct_mean", "pct_min", "pct_max", F.sqrt(F.col("ss") / F.col("n")).alias("pct_std"))
    pm = df.agg(exact_avg(p).alias("mean_prediction"), F.stddev_pop(F.col(p)).alias("std_prediction"))
    return ranking.join_small(s, pm, [], 1)


def evaluate(df: DataFrame, y: str = "y_true", p: str = "y_pred", group_cols: list[str] | None = None,
             limits: tuple[float, float] = LIMITS) -> DataFrame:
    """Regression + banded classification metrics per group (wide: one row per group), in one pass: the nine cells of
    the confusion matrix are conditional counts beside the regression sums, and everything else follows from them."""
    g = list(group_cols or [])
    cells = [(a, b) for a in LABELS for b in LABELS]
    err, ba, bb = F.col(y) - F.col(p), band3(y, *limits), band3(p, *limits)
    sums = [F.count(F.lit(1)).alias("n"), exact_sum(err * err).alias("sse"), exact_sum(F.abs(err)).alias("sae"), F.var_pop(F.col(y)).alias("vy"),
            *[F.sum(F.when((ba == a) & (bb == b), 1).otherwise(0)).alias(f"c{a}{b}") for a, b in cells]]
    m = df.groupBy(*g).agg(*sums) if g else df.agg(*sums)
    tp = {k: F.col(f"c{k}{k}") for k in LABELS}
    support = {k: sum((F.col(f"c{k}{b}") for b in LABELS), F.lit(0)) for k in LABELS}
    named = {k: sum((F.col(f"c{a}{k}") for a in LABELS), F.lit(0)) for k in LABELS}
    present = {k: (support[k] + named[k]) > 0 for k in LABELS}
    prec, rec = {k: _safe_div(tp[k], named[k]) for k in LABELS}, {k: _safe_div(tp[k], support[k]) for k in LABELS}
    f1 = {k: F.when(prec[k] + rec[k] == 0, F.lit(0.0)).otherwise(2 * prec[k] * rec[k] / (prec[k] + rec[k])) for k in LABELS}
    n_labels = sum((present[k].cast("int") for k in LABELS), F.lit(0))
    macro = lambda x: sum((F.when(present[k], x[k]).otherwise(F.lit(0.0)) for k in LABELS), F.lit(0.0)) / n_labels
    sst = F.col("vy") * F.col("n")
    r2 = F.when(sst == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) - F.col("sse") / sst)
    total = sum((F.col(f"c{a}{b}") for a, b in cells), F.lit(0))
    return m.select(*g, "n", (F.col("sse") / F.col("n")).alias("mse"), (F.col("sae") / F.col("n")).alias("mae"), r2.alias("r2"),
                    F.try_divide(sum(tp.values(), F.lit(0)).cast("double"), total).alias("accuracy"),
                    macro(prec).alias("precision_macro"), macro(rec).alias("recall_macro"), macro(f1).alias("f1_macro"))


METRICS = ["mse", "mae", "r2", "accuracy", "precision_macro", "recall_macro", "f1_macro"]


def metrics_long(wide: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    g = list(group_cols or [])
    return wide.select(*g, *METRICS).unpivot(g, METRICS, "metric", "value") if g else \
        wide.select(*METRICS).unpivot([], METRICS, "metric", "value")


def compare(new: DataFrame, prod: DataFrame, improvement_threshold: float = 0.01) -> DataFrame:
    """Sign-aware metric differences (lower-is-better for mse/mae) and ``is_better``."""
    n = new.select(*[F.col(m).alias(f"new_{m}") for m in METRICS])
    o = prod.select(*[F.col(m).alias(f"prod_{m}") for m in METRICS])
    j = ranking.join_small(n, o, [], 1)
    diffs = {f"{m}_diff": (F.col(f"prod_{m}") - F.col(f"new_{m}")) if m in ("mse", "mae")
             else (F.col(f"new_{m}") - F.col(f"prod_{m}")) for m in METRICS}
    j = j.select(*[v.alias(k) for k, v in diffs.items()])
    return j.withColumn("is_better", (F.col("r2_diff") > improvement_threshold) & (F.col("accuracy_diff") > 0))
